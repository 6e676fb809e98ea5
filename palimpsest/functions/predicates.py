"""What a whole value (without white space around it) looks like: one boolean expression for each kind."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from palimpsest.functions import dates
from palimpsest.functions.dictionaries import get_dictionary
from palimpsest.sql import Spark

# What the kinds look like. Alternations stand for back-references, which one of the engines lacks.
LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL = rf"^[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*@{LABEL}(?:\.{LABEL})+\z"
URL = r"^(?i:https?://|www\.)[^\s]+\z"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}\z"
UUID = r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\z"
SSN_FULL = r"^[0-9]{3}(?:[0-9]{2}|-[0-9]{2}-| [0-9]{2} )[0-9]{4}\z"
SSN_PARTIAL = "^(?:" + "|".join(f"{m}{{3}}{s}{m}{{2}}{s}" for m in ("X", "x", r"\*") for s in ("", "-", " ")) + r")[0-9]{4}\z"
CARD = r"^[0-9]+(?:[ -][0-9]+)*\z"
ZIP = r"^[0-9]{5}(?:-[0-9]{4})?\z"
PHONE = r"^(?i:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}(?:\s*(?:ext\.?|x|#)\s*[0-9]{1,6})?)\z"
SUFFIXES = "st|street|ave|avenue|rd|road|blvd|boulevard|ln|lane|dr|drive|ct|court|way|pl|place|ter|terrace|cir|circle|pkwy|parkway|hwy|highway"
ADDRESS = rf"^(?i:[0-9]+[a-z]?\s+[\p{{L}}\p{{N}}_'.\- ]+?\s+(?:{SUFFIXES})\.?(?:\s+(?:apt|ste|suite|unit|#)\s*[\p{{L}}\p{{N}}_-]+)?)\z"
NAME_PART = r"['’.-]*\p{L}[\p{L}'’.-]*"
FULL_NAME = rf"^{NAME_PART}(?:\s+{NAME_PART}){{0,5}}\z"
BRANDS = (
    ("visa", "4", (13, 16, 19), r"^4"),
    ("mastercard", "51", (16,), r"^(?:5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)"),
    ("amex", "34", (15,), r"^3[47]"),
    ("discover", "6011", (16, 19), r"^(?:6011|64[4-9]|65)"),
)
TEST_WORDS = ("test", "dummy", "sample", "example", "xxx", "yyy", "zzz", "n/a", "na", "null", "none")
WHITE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

Test = Callable[[Spark, str], str]


def strip(d: Spark, v: str) -> str:
    """v without any kind of white space around it."""
    return d.replace(v, rf"^{WHITE}+|{WHITE}+\z", "")


def digits_of(d: Spark, v: str) -> str:
    return d.replace(v, "[^0-9]", "")


def email(d: Spark, v: str) -> str:
    return f"({d.matches(v, EMAIL)} AND length({v}) <= 254 AND length({d.extract(v, '^[^@]*')}) <= 64)"


def ssn_full(d: Spark, v: str) -> str:
    n = digits_of(d, v)
    return f"({d.matches(v, SSN_FULL)} AND substr({n}, 1, 3) BETWEEN '001' AND '899' AND substr({n}, 1, 3) <> '666' AND substr({n}, 4, 2) <> '00' AND substr({n}, 6, 4) <> '0000')"


def ssn_partial(d: Spark, v: str) -> str:
    return f"({d.matches(v, SSN_PARTIAL)} AND right({v}, 4) <> '0000')"


def ssn(d: Spark, v: str) -> str:
    return f"({ssn_full(d, v)} OR {ssn_partial(d, v)})"


def luhn_sum(d: Spark, digits: str) -> str:
    """The Luhn sum of a text of digits, up to 19: each term counts from the right."""
    terms = []
    for k in range(19):
        digit = f"CAST(CASE WHEN length({digits}) > {k} THEN substr({digits}, length({digits}) - {k}, 1) ELSE '0' END AS INT)"
        terms.append(digit if k % 2 == 0 else f"(2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)")
    return "(" + " + ".join(terms) + ")"


def credit_card(d: Spark, v: str) -> str:
    n = digits_of(d, v)
    luhn = f"luhn_check({n})" if d.name == "spark" else f"{luhn_sum(d, n)} % 10 = 0"
    brand = " OR ".join(f"(length({n}) IN ({', '.join(map(str, lengths))}) AND {d.matches(n, prefix)})" for _, _, lengths, prefix in BRANDS)
    different = f"replace({n}, substr({n}, 1, 1), '') <> ''"
    return f"(CASE WHEN {d.matches(v, CARD)} AND length({n}) BETWEEN 13 AND 19 THEN {different} AND ({brand}) AND {luhn} ELSE FALSE END)"


def city(d: Spark, v: str) -> str:
    known = ", ".join(d.text(c.lower()) for c in get_dictionary("us_cities")) or "NULL"
    return f"coalesce(lower({v}) IN ({known}), FALSE)"


def date(d: Spark, v: str, date_order: str = "MDY") -> str:
    return f"({dates.parsed(d, v, date_order)} IS NOT NULL)"


def test_data(d: Spark, v: str) -> str:
    """Placeholders that need no masking; null isn't one."""
    s = strip(d, v)
    words = ", ".join(d.text(w) for w in TEST_WORDS)
    return f"coalesce(length({s}) <= 1 OR (length({s}) <= 10 AND replace({s}, substr({s}, 1, 1), '') = '') OR lower({s}) IN ({words}), FALSE)"


def marker(d: Spark, v: str, markers: list[str]) -> str:
    """A value that stands for null in its column."""
    return f"coalesce({strip(d, v)} IN ({', '.join(d.text(m) for m in markers)}), FALSE)" if markers else "FALSE"


def _regex(pattern: str) -> Test:
    return lambda d, v: d.matches(v, pattern)


@dataclass(frozen=True)
class Pattern:
    """A kind of value: test gives SQL for (dialect, SQL of the value). min_ratio: of nonblank samples that must pass."""

    name: str
    test: Test
    min_ratio: float = 0.9

    def __post_init__(self):
        if not 0 < self.min_ratio <= 1:
            raise ValueError("min_ratio must be above 0 and at most 1")


def default_patterns(min_ratio: float = 0.9, date_order: str = "MDY") -> list[Pattern]:
    tests = {
        "email": email,
        "url": _regex(URL),
        "ip_address": _regex(IP),
        "uuid": _regex(UUID),
        "ssn": ssn,
        "credit_card": credit_card,
        "zip_code": _regex(ZIP),
        "phone": _regex(PHONE),
        "address": _regex(ADDRESS),
        "city": city,
        "full_name": _regex(FULL_NAME),
        "date": lambda d, v: date(d, v, date_order),
    }
    return [Pattern(name, test, min_ratio) for name, test in tests.items()]


# The words in a column's name that hint at a kind.
HINTS = {
    "email": {"email", "e_mail"},
    "phone": {"phone", "telephone", "tel", "mobile", "cell", "fax"},
    "ssn": {"ssn", "social_security"},
    "date": {"date", "datetime", "timestamp", "dob", "birth_date", "birthdate", "birth", "happened_on"},
    "credit_card": {"credit_card", "card_number", "card_no", "card_num", "pan", "cc_number"},
    "zip_code": {"zip", "zipcode", "postal_code", "postcode"},
    "city": {"city", "town"},
    "full_name": {"full_name", "first_name", "last_name", "middle_name", "given_name", "surname", "family_name", "person_name", "customer_name"},
    "address": {"street", "address", "addr"},
    "ip_address": {"ip", "ipv4"},
    "url": {"url", "website", "uri"},
    "uuid": {"uuid", "guid"},
}
#: Kinds that only the column's name or type can confirm; those of the second set if a match is digits alone.
NEED_CONTEXT, NEED_CONTEXT_AS_DIGITS = ("full_name", "city", "zip_code", "credit_card"), ("phone", "ssn", "date")


def name_tokens(column: str) -> list[str]:
    """The words of a name in camel case, snake case or anything between."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+", column)]


def column_hints(column: str, data_type: str = "") -> set[str]:
    tokens = name_tokens(column)
    spelled = {"_".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1)}
    hints = {kind for kind, words in HINTS.items() if spelled & words}
    if hints & {"email", "ip_address"}:  # email_address and ip_address are no postal addresses
        hints.discard("address")
    if re.match(r"(date|datetime\d*|timestamp(_ntz|_ltz)?|smalldatetime)\b", data_type.lower()):
        hints.add("date")
    return hints
