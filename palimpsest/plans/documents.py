"""What the control documents share."""

from __future__ import annotations

import traceback
from datetime import UTC, datetime


def pairs_once(pairs: list) -> dict:
    """For json.load: an object in which no key is repeated."""
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def safe(error: BaseException) -> str:
    """An error's type and where in this library it arose; its text may hold values and isn't shown."""
    frames = [f for f in traceback.extract_tb(error.__traceback__) if "palimpsest" in f.filename]
    return type(error).__name__ + (f" at {frames[-1].filename.rsplit('/', 1)[-1]}:{frames[-1].lineno}" if frames else "")
