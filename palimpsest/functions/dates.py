"""Dates in text: recognised, shifted and written back in the layout in which they stood."""

from __future__ import annotations

from dataclasses import dataclass

from palimpsest.sql import Spark

MONTHS = "January February March April May June July August September October November December".split()
SUFFIX = r"(?:[ T](?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.(?:[0-9]{3}|[0-9]{6}|[0-9]{1,6}))?)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?"
NAMES = "|".join([*MONTHS, *(m[:3] for m in MONTHS), *(m.upper() for m in MONTHS), *(m[:3].upper() for m in MONTHS), *(m.lower() for m in MONTHS), *(m[:3].lower() for m in MONTHS)])


@dataclass(frozen=True)
class Layout:
    """Five groups: a part, a separator, a part, a separator and a part; order says which part is which."""

    order: str
    regex: str
    named: bool = False


def layouts(date_order: str = "MDY") -> list[Layout]:
    if date_order not in ("MDY", "DMY"):
        raise ValueError("date_order must be MDY or DMY")
    one, year = r"([0-9]{1,2})", r"([0-9]{4})"
    out = [Layout("YMD", r"([0-9]{4})()([0-9]{2})()([0-9]{2})")]
    out += [Layout("YMD", f"{year}({s}){one}({s}){one}") for s in "/-"]
    out += [Layout(date_order, f"{one}({s}){one}({s}){year}") for s in "/-"]
    out += [Layout("DMY", rf"{one}(\.){one}(\.){year}")]
    out += [Layout("DMY", f"{one}({s})({NAMES})({s}){year}", named=True) for s in " -"]
    out += [Layout("MDY", f"({NAMES})( +){one}(,? +){year}", named=True)]
    return out


def _full(layout: Layout) -> str:
    return f"^{layout.regex}({SUFFIX})\\z"


def _number(d: Spark, layout: Layout, part: str, group: str) -> str:
    """The part as digits."""
    if part == "M" and layout.named:
        all_months = d.text("".join(m[:3].lower() for m in MONTHS))
        return f"CAST({d.div(f'instr({all_months}, lower(substr({group}, 1, 3))) + 2', 3)} AS {d.string})"
    return group


def date_of(d: Spark, layout: Layout, v: str) -> str:
    """The date in a value of that layout, null if there is no such day."""
    parts = {p: _number(d, layout, p, d.extract(v, _full(layout), 2 * k + 1)) for k, p in enumerate(layout.order)}
    return d.let(parts["Y"], lambda year: f"CASE WHEN {year} <> '0000' THEN {d.to_date(year, parts['M'], parts['D'])} END")


def parsed(d: Spark, v: str, date_order: str = "MDY") -> str:
    """The date in v (without white space around it), null if it is none."""
    cases = " ".join(f"WHEN {d.matches(v, _full(x))} THEN {date_of(d, x, v)}" for x in layouts(date_order))
    return f"CASE {cases} END"


def _month_name(d: Spark, token: str, month: str, between: str) -> str:
    full = d.at(d.array([d.text(m) for m in MONTHS]), month)
    # May is a name and an abbreviation: between hyphens it counts as the latter, elsewhere as the former.
    short = f"length({token}) = 3 AND (lower({token}) <> 'may' OR {between} = '-')"
    name = f"CASE WHEN {short} THEN substr({full}, 1, 3) ELSE {full} END"
    return f"CASE WHEN {token} = upper({token}) THEN upper({name}) WHEN {token} = lower({token}) THEN lower({name}) ELSE {name} END"


def rendered(d: Spark, v: str, date: str, date_order: str = "MDY") -> str:
    """date (an SQL expression) in the layout of v, with v's widths, separators, case of the month's name and time."""
    cases = []
    for layout in layouts(date_order):
        groups = [d.extract(v, _full(layout), k) for k in range(1, 7)]
        shown = []
        for k, part in enumerate(layout.order):
            own = groups[2 * k]
            number = {"Y": f"year({date})", "M": f"month({date})", "D": f"day({date})"}[part]
            if part == "M" and layout.named:
                shown.append(_month_name(d, own, number, groups[1]))
            else:
                digits = f"CAST({number} AS {d.string})"
                width = "4" if part == "Y" else f"CAST(length({own}) AS INT)"
                shown.append(f"CASE WHEN length({digits}) < {width} THEN lpad({digits}, {width}, '0') ELSE {digits} END")
        cases.append(f"WHEN {d.matches(v, _full(layout))} THEN concat({shown[0]}, {groups[1]}, {shown[1]}, {groups[3]}, {shown[2]}, {groups[5]})")
    return f"CASE {' '.join(cases)} END"


def shifted(d: Spark, date: str, state: str) -> str:
    """date moved by 30 to 730 days, the other way where the years 1 to 9999 would be left."""
    from palimpsest.functions.prf import draw

    days = f"(30 + {draw(d, state, 'days', 701)})"
    sign = f"(CASE WHEN {draw(d, state, 'sign', 2)} = 0 THEN 1 ELSE -1 END)"
    fits = f"CASE WHEN year({date}) >= 9997 THEN -1 WHEN year({date}) <= 3 THEN 1 ELSE {sign} END"
    return d.add_days(date, f"{days} * {fits}")
