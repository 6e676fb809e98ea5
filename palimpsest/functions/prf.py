"""Deterministic draws from a keyed hash of a value: the same seed and value give the same draws everywhere."""

from __future__ import annotations

import hashlib

from palimpsest.sql import Spark

DIGITS = 4  # hexadecimal digits of a draw for a character
PER_BLOCK = 64 // DIGITS


def seed_key(seed: str) -> str:
    """What plans and the UI may show of a seed."""
    return hashlib.sha256(seed.encode()).hexdigest()


def state(d: Spark, key: str, value: str) -> str:
    """The hash all draws for a value derive from. key: from seed_key()."""
    return d.sha256(f"concat('{key}:', {value})")


def draw(d: Spark, state_sql: str, k: int, n: int | str) -> str:
    """The k-th draw, from 0 to n - 1. Of 60 bits, so that no n in use is noticeably uneven."""
    block = d.sha256(f"concat({state_sql}, ':{k}')")
    return f"({d.unhex(f'substr({block}, 1, 15)')} % {n})"


def character_draws(d: Spark, state_sql: str, value: str) -> str:
    """Four hexadecimal digits for each character, and some to spare: one hash for every 16 characters."""
    last = d.div(f"greatest(length({value}) - 1, 0)", PER_BLOCK)
    blocks = d.each(d.numbers("0", last), lambda x, i: d.sha256(f"concat({state_sql}, ':c', CAST({x} AS {d.string}))"))
    return d.extract_all(d.join(blocks), f"[0-9a-f]{{{DIGITS}}}")


def other(d: Spark, original: str, drawn: str, n: int) -> str:
    """A member of a class of n (numbered from 0) that isn't the original."""
    return f"(({original} + 1 + {drawn} % {n - 1}) % {n})"
