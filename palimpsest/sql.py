"""The few places where Spark SQL and the oracle's SQL spell the same thing differently.

Expressions of this library are SQL text, built for a dialect: Spark's (its Columns come from F.expr, so Catalyst plans
them whole) or DuckDB's, for the oracle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable


def text(value: str) -> str:
    """A string literal without backslashes or quotes in it."""
    if "\\" in value:
        raise ValueError("use Dialect.pattern() for patterns")
    return "'" + value.replace("'", "''") + "'"


_names = itertools.count()


class Spark:
    name = "spark"
    string, integer = "STRING", "BIGINT"

    def pattern(self, regex: str) -> str:
        # A raw literal takes no escapes, so a quote is written as its code.
        return "r'" + regex.replace("'", r"\x27") + "'"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def matches(self, x: str, regex: str) -> str:
        return f"({x}) RLIKE {self.pattern(regex)}"

    def extract(self, x: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(regex)}, {group})"

    def extract_all(self, x: str, regex: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(regex)}, 0)"

    def replace(self, x: str, regex: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(regex)}, {self.text(by)})"

    def split(self, x: str, regex: str) -> str:
        return f"split({x}, {self.pattern(regex)}, -1)"

    def chars(self, x: str) -> str:
        return f"split({x}, '')"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def unhex(self, x: str) -> str:
        """The number of up to 15 hexadecimal digits."""
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def chr(self, x: str) -> str:
        return f"char({x})"

    def at(self, array: str, index: str) -> str:
        """Counted from 1; null beyond the end."""
        return f"try_element_at({array}, CAST({index} AS INT))"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def join(self, array: str, between: str = "") -> str:
        return f"array_join({array}, {self.text(between)})"

    def each(self, array: str, body: Callable[[str, str], str]) -> str:
        """body gets the names of the item and of its index, from 0."""
        return f"transform({array}, (x, i) -> {body('x', 'i')})"

    def zipped(self, a: str, b: str, body: Callable[[str, str], str]) -> str:
        return f"zip_with({a}, {b}, (x, y) -> {body('x', 'y')})"

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """body of a name that stands for value, which is evaluated once however often the name occurs."""
        name = f"v{next(_names)}"
        return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"

    def numbers(self, low: str, high: str) -> str:
        return f"sequence(CAST({low} AS INT), CAST({high} AS INT))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def sorted(self, array: str) -> str:
        return f"sort_array({array})"

    def pair(self, a: str, b: str) -> str:
        return f"named_struct('a', {a}, 'b', {b})"

    def tail(self, array: str) -> str:
        return f"slice({array}, 2, greatest(size({array}) - 1, 0))"

    def append(self, a: str, b: str) -> str:
        return f"concat({a}, array({b}))"

    def to_date(self, y: str, m: str, d: str) -> str:
        shown = f"concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0'))"
        return f"try_to_date({shown}, 'yyyy-MM-dd')"

    def add_days(self, date: str, days: str) -> str:
        return f"date_add({date}, CAST({days} AS INT))"

    def div(self, a: str, b: int) -> str:
        return f"({a}) div {b}"

    def count_if(self, x: str) -> str:
        return f"count_if({x})"

    def try_cast(self, x: str, kind: str) -> str:
        return f"try_cast({x} AS {kind})"


class Duck(Spark):
    name = "duck"
    string, integer = "VARCHAR", "BIGINT"

    def pattern(self, regex: str) -> str:
        return "'" + regex.replace("'", "''") + "'"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def matches(self, x: str, regex: str) -> str:
        return f"regexp_matches({x}, {self.pattern(regex)})"

    def extract(self, x: str, regex: str, group: int = 0) -> str:
        return f"coalesce(regexp_extract({x}, {self.pattern(regex)}, {group}), '')"

    def replace(self, x: str, regex: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(regex)}, {self.text(by)}, 'g')"

    def split(self, x: str, regex: str) -> str:
        return f"regexp_split_to_array({x}, {self.pattern(regex)})"

    def chars(self, x: str) -> str:
        return f"list_transform(range(1, length({x}) + 1), lambda k: substr({x}, k, 1))"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def unhex(self, x: str) -> str:
        return f"CAST('0x' || {x} AS BIGINT)"

    def chr(self, x: str) -> str:
        return f"chr(CAST({x} AS INT))"

    def at(self, array: str, index: str) -> str:
        return f"({array})[{index}]"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def join(self, array: str, between: str = "") -> str:
        return f"array_to_string({array}, {self.text(between)})"

    def each(self, array: str, body: Callable[[str, str], str]) -> str:
        return f"list_transform({array}, lambda x, j: {body('x', '(j - 1)')})"

    def zipped(self, a: str, b: str, body: Callable[[str, str], str]) -> str:
        return f"list_transform(list_zip({a}, {b}), lambda z: {body('z[1]', 'z[2]')})"

    def let(self, value: str, body: Callable[[str], str]) -> str:
        name = f"v{next(_names)}"
        return f"(list_transform([{value}], lambda {name}: {body(name)}))[1]"

    def numbers(self, low: str, high: str) -> str:
        return f"range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1)"

    def size(self, array: str) -> str:
        return f"len({array})"

    def sorted(self, array: str) -> str:
        return f"list_sort({array})"

    def pair(self, a: str, b: str) -> str:
        return f"{{'a': {a}, 'b': {b}}}"

    def tail(self, array: str) -> str:
        return f"({array})[2:]"

    def append(self, a: str, b: str) -> str:
        return f"list_concat({a}, [{b}])"

    def to_date(self, y: str, m: str, d: str) -> str:
        shown = f"(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'))"
        return f"TRY_CAST({shown} AS DATE)"

    def add_days(self, date: str, days: str) -> str:
        return f"CAST({date} + CAST({days} AS INT) AS DATE)"

    def div(self, a: str, b: int) -> str:
        return f"({a}) // {b}"

    def count_if(self, x: str) -> str:
        return f"CAST(count(*) FILTER ({x}) AS BIGINT)"

    def try_cast(self, x: str, kind: str) -> str:
        return f"TRY_CAST({x} AS {kind})"


SPARK, DUCK = Spark(), Duck()
