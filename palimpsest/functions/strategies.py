"""Masking strategies: what replaces a value, as SQL expressions of the value and a keyed hash of it.

The same seed and value give the same replacement everywhere, and a value with content never stays (nor differs by case
alone): where a class of characters is drawn from, the original is left out. A strategy says which values it can replace
(valid); the others are counted by the mask's gate, which never shows them. Null stays null, but for `blank`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import dates, predicates
from palimpsest.functions.dictionaries import get_dictionary
from palimpsest.functions.prf import character_draws, draw, other, seed_key, state
from palimpsest.sql import SPARK, Spark

ALNUM = r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class Strategy:
    """mask(dialect, value, key): SQL of the replacement of a non-null text; valid(dialect, value): which it can replace.

    blank: what becomes of values of white space only - "keep", or "invent" a replacement as for any other. column:
    instead of mask, a function from a Column to one, for strategies registered at run time. version: part of the seed
    map's scope, so that a change of form starts new pairs.
    """

    name: str
    mask: Callable[[Spark, str, str], str] | None = None
    valid: Callable[[Spark, str], str] | None = None
    blank: str = "keep"
    needs_text: bool = True
    column: Callable[[Column], Column] | None = None
    version: str = ""


def redact(d: Spark, v: str, key: str) -> str:
    return d.replace(v, ALNUM, "*")


def _character(d: Spark, c: str, hex_digits: str) -> str:
    n = d.unhex(hex_digits)

    def moved(first: int, size: int) -> str:
        return d.chr(f"{first} + {other(d, f'(ascii({c}) - {first})', n, size)}")

    upper, lower = d.chr(f"65 + {n} % 26"), d.chr(f"97 + {n} % 26")
    return (
        f"CASE WHEN {c} BETWEEN '0' AND '9' THEN {moved(48, 10)} WHEN {c} BETWEEN 'a' AND 'z' THEN {moved(97, 26)} WHEN {c} BETWEEN 'A' AND 'Z' THEN {moved(65, 26)} "
        f"WHEN ascii({c}) < 128 THEN {c} WHEN {d.matches(c, r'\p{Lu}')} THEN {upper} WHEN {d.matches(c, r'\p{Ll}')} THEN {lower} WHEN {d.matches(c, r'\p{Nd}')} THEN {d.chr(f'48 + {n} % 10')} ELSE {c} END"
    )


def format_random(d: Spark, v: str, key: str) -> str:
    draws = d.let(state(d, key, v), lambda s: character_draws(d, s, v))
    return d.join(d.zipped(d.chars(v), draws, lambda c, x: f"CASE WHEN {c} IS NULL THEN '' ELSE {_character(d, c, x)} END"))


def can_move(d: Spark, v: str) -> str:
    return f"({d.matches(v, r'[\p{Lu}\p{Ll}\p{Nd}]')} OR NOT {d.matches(v, r'[^\s]')})"


def shuffle(d: Spark, v: str, key: str) -> str:
    found = d.extract_all(v, ALNUM)
    draws = character_draws(d, state(d, key, v), v)
    paired = d.zipped(found, draws, lambda c, x: f"CASE WHEN {c} IS NOT NULL THEN {d.pair(x, c)} END")
    kept = f"filter({paired}, x -> x IS NOT NULL)" if d.name == "spark" else f"list_filter({paired}, lambda x: x IS NOT NULL)"
    mixed = d.each(d.sorted(kept), lambda x, i: f"{x}.b")
    turned = d.append(d.tail(found), d.at(found, "1"))
    chosen = f"CASE WHEN lower({d.join(mixed)}) = lower({d.join(found)}) THEN {turned} ELSE {mixed} END"
    return d.join(d.zipped(d.split(v, ALNUM), chosen, lambda gap, c: f"concat({gap}, coalesce({c}, ''))"))


def can_shuffle(d: Spark, v: str) -> str:
    """At least two different characters, by case too."""
    low = f"lower({d.replace(v, r'[^\p{L}\p{N}]', '')})"
    return f"(replace({low}, substr({low}, 1, 1), '') <> '' OR {low} = '')"


def pick(d: Spark, names: list[str], v: str, state_sql: str, k: str) -> str:
    """A name of the list that isn't v."""
    listed = d.array([d.text(n) for n in names])
    at = draw(d, state_sql, k, len(names))
    return f"CASE WHEN lower({d.at(listed, f'1 + {at}')}) = lower({v}) THEN {d.at(listed, f'1 + ({at} + 1) % {len(names)}')} ELSE {d.at(listed, f'1 + {at}')} END"


def from_dictionary(name: str) -> Strategy:
    """A strategy that picks from a registered list; as format_random if the list is empty."""

    def mask(d: Spark, v: str, key: str) -> str:
        names = get_dictionary(name)
        return pick(d, names, v, state(d, key, v), name) if names else format_random(d, v, key)

    def valid(d: Spark, v: str) -> str:
        names = get_dictionary(name)
        if not names:
            return can_move(d, v)
        return "TRUE" if len({n.lower() for n in names}) > 1 else f"(lower({v}) <> {d.text(names[0].lower())})"

    return Strategy(f"dictionary:{name}", mask, valid, blank="invent")


def fake_name(d: Spark, v: str, key: str) -> str:
    s, last = state(d, key, v), get_dictionary("last_names")
    first = pick(d, get_dictionary("first_names"), v, s, "first")
    listed, at = d.array([d.text(n) for n in last]), draw(d, s, "last", len(last))
    whole = f"concat({first}, ' ', {d.at(listed, f'1 + {at}')})"
    return f"CASE WHEN lower({whole}) = lower({v}) THEN concat({first}, ' ', {d.at(listed, f'1 + ({at} + 1) % {len(last)}')}) ELSE {whole} END"


def _local_part(d: Spark, v: str, s: str) -> str:
    first, last = (d.array([d.text(n.lower()) for n in get_dictionary(x)]) for x in ("first_names", "last_names"))
    a, b = draw(d, s, "first", len(get_dictionary("first_names"))), draw(d, s, "last", len(get_dictionary("last_names")))
    return f"concat({d.at(first, f'1 + {a}')}, '.', {d.at(last, f'1 + {b}')}, "


def fake_email(d: Spark, v: str, key: str) -> str:
    s = state(d, key, v)
    n = draw(d, s, "number", 999)
    made = _local_part(d, v, s) + f"CAST(1 + {n} AS {d.string}), '@example.invalid')"
    next_one = _local_part(d, v, s) + f"CAST(1 + ({n} + 1) % 999 AS {d.string}), '@example.invalid')"
    return f"CASE WHEN {made} = lower({v}) THEN {next_one} ELSE {made} END"


def fake_email_keep_domain(d: Spark, v: str, key: str) -> str:
    s, at = state(d, key, v), d.extract(v, "(?s)@(.*)", 1)
    domain = f"CASE WHEN {d.matches(v, '@')} THEN {at} ELSE 'example.invalid' END"
    n = draw(d, s, "number", 999)
    made, next_one = (_local_part(d, v, s) + f"CAST(1 + {x} AS {d.string}), '@', {domain})" for x in (n, f"({n} + 1) % 999"))
    return f"CASE WHEN lower({made}) = lower({v}) THEN {next_one} ELSE {made} END"


def fake_ip(d: Spark, v: str, key: str) -> str:
    s = state(d, key, v)
    octets = [f"(1 + {draw(d, s, f'octet{k}', 254)})" for k in range(4)]
    shown = [f"CAST({x} AS {d.string})" for x in octets]
    own = f"CAST({d.extract(v, r'[0-9]+\z')} AS INT)"
    last = f"CAST(CASE WHEN {octets[3]} = {own} THEN 1 + {octets[3]} % 254 ELSE {octets[3]} END AS {d.string})"
    four = f"concat({shown[0]}, '.', {shown[1]}, '.', {shown[2]}, '.', {last})"
    draws = character_draws(d, s, v)
    six = d.join(
        d.zipped(
            d.chars(v),
            draws,
            lambda c, x: (
                f"CASE WHEN {c} IS NULL THEN '' WHEN {c} BETWEEN '0' AND '9' THEN substr('0123456789abcdef', 1 + CAST({other(d, f'(ascii({c}) - 48)', d.unhex(x), 16)} AS INT), 1) "
                f"WHEN {c} BETWEEN 'a' AND 'f' THEN substr('0123456789abcdef', 1 + CAST({other(d, f'(ascii({c}) - 87)', d.unhex(x), 16)} AS INT), 1) "
                f"WHEN {c} BETWEEN 'A' AND 'F' THEN substr('0123456789ABCDEF', 1 + CAST({other(d, f'(ascii({c}) - 55)', d.unhex(x), 16)} AS INT), 1) ELSE {c} END"
            ),
        )
    )
    return f"CASE WHEN {d.matches(v, predicates.IP)} THEN {four} WHEN {d.matches(v, ':')} THEN {six} ELSE {format_random(d, v, key)} END"


def fake_uuid(d: Spark, v: str, key: str) -> str:
    h = state(d, key, v)
    variant = f"substr('89ab', 1 + CAST({draw(d, h, 'variant', 4)} AS INT), 1)"
    made = f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-4', substr({h}, 14, 3), '-', {variant}, substr({h}, 18, 3), '-', substr({h}, 21, 12))"
    cased = f"CASE WHEN {v} = upper({v}) AND {v} <> lower({v}) THEN upper({made}) ELSE {made} END"
    return f"CASE WHEN {d.matches(v, r'^\{.*\}\z')} THEN concat('{{', {cased}, '}}') ELSE {cased} END"


def put_digits(d: Spark, v: str, digits: str) -> str:
    """The digits of v replaced, in order, by those of another text."""
    return d.join(d.zipped(d.split(v, "[0-9]"), d.chars(digits), lambda gap, c: f"concat({gap}, coalesce({c}, ''))"))


def phone_valid(d: Spark, v: str) -> str:
    return d.matches(predicates.strip(d, v), predicates.PHONE)


def fake_phone(d: Spark, v: str, key: str) -> str:
    t = predicates.strip(d, v)
    s, n = state(d, key, t), predicates.digits_of(d, t)
    country = f"CASE WHEN {d.matches(t, r'^\+?1')} THEN '1' ELSE '' END"
    at = f"length({country})"
    three = lambda k: f"concat(CAST(2 + {draw(d, s, f'{k}a', 8)} AS {d.string}), lpad(CAST({draw(d, s, f'{k}b', 100)} AS {d.string}), 2, '0'))"
    line = f"lpad(CAST({draw(d, s, 'line', 1000)} AS {d.string}), 3, '0')"
    last = f"CAST({other(d, f'CAST(substr({n}, {at} + 10, 1) AS INT)', draw(d, s, 'last', 9), 10)} AS {d.string})"
    beyond = f"greatest(length({n}) - {at} - 10, 0)"
    extension = f"substr(lpad(CAST({draw(d, s, 'extension', 1000000)} AS {d.string}), 6, '0'), 1, CAST({beyond} AS INT))"
    made = f"concat({country}, {three('area')}, {three('exchange')}, {line}, {last}, {extension})"
    return put_digits(d, v, made)


def ssn_valid(d: Spark, v: str) -> str:
    return predicates.ssn(d, predicates.strip(d, v))


def fake_ssn(d: Spark, v: str, key: str) -> str:
    t = predicates.strip(d, v)
    s, n = state(d, key, t), predicates.digits_of(d, t)
    area = draw(d, s, "area", 799)  # 100 to 899 without 666
    area = f"(100 + {area} + CASE WHEN {area} >= 566 THEN 1 ELSE 0 END)"
    group = f"lpad(CAST(1 + {draw(d, s, 'group', 99)} AS {d.string}), 2, '0')"
    serial = f"lpad(CAST(1 + {other(d, f'(CAST(right({n}, 4) AS INT) - 1)', draw(d, s, 'serial', 9998), 9999)} AS {d.string}), 4, '0')"
    full = put_digits(d, v, f"concat(CAST({area} AS {d.string}), {group}, {serial})")
    return f"CASE WHEN {predicates.ssn_partial(d, t)} THEN {put_digits(d, v, serial)} ELSE {full} END"


def card_valid(d: Spark, v: str) -> str:
    return predicates.credit_card(d, predicates.strip(d, v))


def fake_credit_card(d: Spark, v: str, key: str) -> str:
    prefix = lambda n: "CASE " + " ".join(f"WHEN {d.matches(n, regex)} THEN '{start}'" for _, start, _, regex in predicates.BRANDS) + " ELSE '' END"

    def whole(body: str) -> str:
        return d.let(body, lambda x: f"concat({x}, CAST((10 - {d.let(f"concat({x}, '0')", lambda y: predicates.luhn_sum(d, y))} % 10) % 10 AS {d.string}))")

    def made(n: str, s: str) -> str:
        nine = [f"lpad(CAST({draw(d, s, f'body{k}', 10**9)} AS {d.string}), 9, '0')" for k in range(2)]
        usual = whole(f"substr(concat({prefix(n)}, {nine[0]}, {nine[1]}), 1, length({n}) - 1)")
        spare = whole(f"substr(concat({prefix(n)}, {nine[1]}, {nine[0]}, '7'), 1, length({n}) - 1)")
        return d.let(usual, lambda x: f"CASE WHEN {x} = {n} THEN {spare} ELSE {x} END")

    t = predicates.strip(d, v)
    number = d.let(predicates.digits_of(d, t), lambda n: d.let(state(d, key, t), lambda s: made(n, s)))
    return put_digits(d, v, number)


def date_valid(date_order: str) -> Callable[[Spark, str], str]:
    return lambda d, v: f"({dates.parsed(d, predicates.strip(d, v), date_order)} IS NOT NULL)"


def fake_date(date_order: str = "MDY") -> Callable[[Spark, str, str], str]:
    def mask(d: Spark, v: str, key: str) -> str:
        def moved(t: str) -> str:
            new = d.let(state(d, key, v), lambda s: d.let(dates.parsed(d, t, date_order), lambda day: dates.shifted(d, day, s)))
            return d.let(new, lambda day: dates.rendered(d, t, day, date_order))

        return d.let(predicates.strip(d, v), moved)

    return mask


STRATEGIES: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("null", lambda d, v, key: f"CAST(NULL AS {d.string})", needs_text=False),
        Strategy("blank", lambda d, v, key: "''"),
        Strategy("redact", redact),
        Strategy("format_random", format_random, can_move, needs_text=False),
        Strategy("shuffle", shuffle, can_shuffle, needs_text=False),
        Strategy("fake_first_name", from_dictionary("first_names").mask, blank="invent"),
        Strategy("fake_last_name", from_dictionary("last_names").mask, blank="invent"),
        Strategy("fake_name", fake_name, blank="invent"),
        Strategy("fake_city", from_dictionary("us_cities").mask, blank="invent"),
        Strategy("fake_email", fake_email, blank="invent"),
        Strategy("fake_email_keep_domain", fake_email_keep_domain, blank="invent"),
        Strategy("fake_ip", fake_ip, can_move),
        Strategy("fake_uuid", fake_uuid, blank="invent"),
        Strategy("fake_phone", fake_phone, phone_valid, needs_text=False),
        Strategy("fake_ssn", fake_ssn, ssn_valid, needs_text=False, version="1"),
        Strategy("fake_date", fake_date(), date_valid("MDY"), needs_text=False, version="1"),
        Strategy("fake_credit_card", fake_credit_card, card_valid, needs_text=False, version="1"),
    )
}

# What a kind of value is masked with unless configured.
DEFAULT_RULE_STRATEGIES = {
    "email": "fake_email",
    "full_name": "fake_name",
    "first_name": "fake_first_name",
    "last_name": "fake_last_name",
    "city": "fake_city",
    "phone": "fake_phone",
    "ssn": "fake_ssn",
    "credit_card": "fake_credit_card",
    "zip_code": "format_random",
    "ip_address": "fake_ip",
    "uuid": "fake_uuid",
    "date": "fake_date",
    "address": "redact",
    "date_of_birth": "fake_date",
}


def get_strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def register_strategy(name: str, strategy: Strategy | Callable[[Column], Column]) -> None:
    """strategy: a Strategy, or a function from a Column to a Column (a pandas UDF, say)."""
    STRATEGIES[name] = strategy if isinstance(strategy, Strategy) else Strategy(name, column=strategy)


def text_sql(d: Spark, strategy: Strategy, v: str, key: str) -> str:
    """The replacement of a text that may be null or blank."""
    if strategy.name == "blank":
        return "''"
    made = strategy.mask(d, v, key)
    if strategy.name == "null":
        return made
    if strategy.blank == "keep":
        made = f"CASE WHEN {d.matches(v, r'[^\s]')} THEN {made} ELSE {v} END"
    return f"CASE WHEN {v} IS NULL THEN NULL ELSE {made} END"


def valid_sql(d: Spark, strategy: Strategy, v: str) -> str:
    """Whether a value can be replaced; null and blank ones always can."""
    if strategy.valid is None:
        return "TRUE"
    return f"({v} IS NULL OR NOT {d.matches(v, r'[^\s]')} OR {strategy.valid(d, v)})"


def numeric_sql(d: Spark, v: str, kind: str, key: str) -> str:
    """Digits replaced, sign and point kept; the first digit stays above 0 where it was."""
    shown = f"CAST({v} AS {d.string})"
    draws = character_draws(d, state(d, key, shown), shown)
    first = d.extract(shown, r"^(-?[1-9])", 1)
    sign = f"CASE WHEN {first} LIKE '-%' THEN '-' ELSE '' END"
    n = d.unhex(d.at(draws, "1"))
    leading = f"CAST(1 + {other(d, f'(ascii(right({first}, 1)) - 49)', n, 9)} AS {d.string})"
    rest = f"CASE WHEN {first} <> '' THEN substr({shown}, length({first}) + 1) ELSE {shown} END"
    others = d.join(d.zipped(d.chars(rest), character_draws(d, state(d, key, shown), shown), lambda c, x: f"CASE WHEN {c} IS NULL THEN '' WHEN {c} BETWEEN '0' AND '9' THEN {d.chr(f'48 + {other(d, f'(ascii({c}) - 48)', d.unhex(x), 10)}')} ELSE {c} END"))
    return d.try_cast(f"CASE WHEN {first} <> '' THEN concat({sign}, {leading}, {others}) ELSE {others} END", kind)


def typed_sql(d: Spark, strategy: Strategy, v: str, kind: str, key: str) -> str:
    """The replacement of a value of a column of that type (Spark's name); the type stays."""
    base = kind.split("(")[0]
    if strategy.name == "null":
        return f"CAST(NULL AS {kind})"
    if base == "string":
        return text_sql(d, strategy, v, key)
    if base in ("date", "timestamp", "timestamp_ntz"):
        shown = f"CAST(CAST({v} AS DATE) AS {d.string})"
        day = dates.shifted(d, f"CAST({v} AS DATE)", state(d, key, shown))
        if base == "date":
            return day
        if d.name == "spark":
            return f"CAST({v} AS {base}) + make_dt_interval(datediff({day}, CAST({v} AS DATE)))"
        return f"{v} + to_days(CAST(date_diff('day', CAST({v} AS DATE), {day}) AS INT))"
    shown = f"CAST({v} AS {d.string})"
    if strategy.name in ("fake_phone", "fake_ssn", "fake_credit_card"):
        return d.try_cast(text_sql(d, strategy, shown, key), kind)
    return f"CASE WHEN {v} IS NOT NULL THEN {numeric_sql(d, v, kind, key)} END"


def output_type_ok(strategy: Strategy, kind: str) -> bool:
    """Whether a column of that type can hold what the strategy makes."""
    base = kind.split("(")[0].lower()
    if strategy.name == "null" or base == "string":
        return True
    if base in ("date", "timestamp", "timestamp_ntz"):
        return strategy.name in ("fake_date", "format_random", "shuffle")
    if base in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return strategy.name in ("format_random", "shuffle", "fake_phone", "fake_ssn", "fake_credit_card")
    return False


def masked(strategy: Strategy, name: str, kind: str, seed: str) -> Column:
    """The masked column as a Spark Column."""
    quoted = f"`{name.replace('`', '``')}`"
    if strategy.column is not None:
        return strategy.column(F.col(quoted))
    return F.expr(typed_sql(SPARK, strategy, quoted, kind, seed_key(seed)))


def valid(strategy: Strategy, name: str, kind: str) -> Column:
    if strategy.valid is None or strategy.column is not None:
        return F.lit(True)
    base = kind.split("(")[0]
    if base in ("date", "timestamp", "timestamp_ntz"):
        return F.lit(True)
    quoted = f"CAST(`{name.replace('`', '``')}` AS STRING)"
    return F.expr(valid_sql(SPARK, strategy, quoted))
