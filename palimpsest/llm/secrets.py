"""Secret scans through a trigram inverted index, with DataFrame operations only.

Each rule's regular expression yields a Boolean trigram query: an OR of clauses, each an AND of trigrams that any match
must contain (lower-cased). The index has a posting (trigram, document) for the trigrams of the rules' queries; a
clause's postings are intersected, and what is left is verified by the regular expression itself. A rule without
mandatory trigrams scans every text.

A rule's matches are leftmost and don't overlap; matches shorter than the rule's least length are dropped but still use
up their characters. Spans count code points, ends exclusive.

Defined cases: null and empty texts have no spans; a text of any length is scanned whole; rows of the same id and text
share their spans; rows of the same id and another text have their own; null ids are a value like any other; an empty
table gives no rows; other columns are ignored by find_secrets() and kept by redact(), whatever their names. Of matches of
two kinds at one place both are spans, and redact() puts one mark for a run of them.
"""

from __future__ import annotations

import functools
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

KEY = ["doc_id", "__text_hash"]
MOST_STRINGS, MOST_CLAUSES, WIDEST_CLASS = 64, 64, 4
Clauses = frozenset  # of frozensets of trigrams; a clause without trigrams asks for nothing
ANYTHING = frozenset({frozenset()})


@dataclass(frozen=True)
class Rule:
    """pattern is understood alike by Python, Java and RE2; least is the least length of group `group` (0: the match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


# The rules' patterns and lengths.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def simplest(clauses: frozenset) -> frozenset:
    """Without clauses that another one implies."""
    kept = frozenset(c for c in clauses if not any(o < c for o in clauses))
    return kept if len(kept) <= MOST_CLAUSES else ANYTHING


def both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=len) if ANYTHING not in (a, b) else (b if a == ANYTHING else a)
    return simplest(frozenset(x | y for x in a for y in b))


def of_strings(strings: set[str]) -> frozenset:
    return simplest(frozenset(trigrams(s) for s in strings))


def analyse(nodes) -> tuple[set[str] | None, frozenset]:
    """All strings (lower-cased) that nodes match, if few, else None; and the clauses of which one holds in any match."""
    run, exact, needed = {""}, True, ANYTHING

    def cut_run():
        nonlocal run, exact, needed
        needed = both(needed, of_strings(run))
        run, exact = {""}, False

    def append(strings: set[str]):
        nonlocal run
        if len(run) * len(strings) > MOST_STRINGS:
            cut_run()
        run = {a + b for a in run for b in strings}

    for op, value in nodes:
        if op is sre.LITERAL:
            append({chr(value).lower()})
        elif op is sre.IN and (chars := small_class(value)):
            append(chars)
        elif op is sre.SUBPATTERN or op is sre.BRANCH:
            options = [analyse(value[3])] if op is sre.SUBPATTERN else [analyse(x) for x in value[1]]
            if all(strings is not None for strings, _ in options):
                append(set().union(*(strings for strings, _ in options)))
            else:
                cut_run()
                needed = both(needed, simplest(frozenset().union(*(clauses for _, clauses in options))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            strings, clauses = analyse(inner)
            if strings is not None and most == 1:
                append(strings | ({""} if least == 0 else set()))
            elif strings is not None and least == most and least <= 4:
                for _ in range(least):
                    append(strings)
            else:
                cut_run()
                if least:
                    needed = both(needed, clauses)
        elif op is sre.AT:
            continue
        else:
            cut_run()
    return (run if exact else None), both(needed, of_strings(run))


def small_class(items) -> set[str]:
    chars: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            chars.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < WIDEST_CLASS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return set()
    return chars if len(chars) <= WIDEST_CLASS + 1 else set()


@functools.cache
def trigram_query(pattern: str) -> frozenset:
    """Clauses of which one holds in any text that pattern matches; ANYTHING if it has no mandatory trigrams."""
    return analyse(parser.parse(pattern))[1]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("__text_hash"), text.alias("text"))


def postings(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index: a row for each trigram of the vocabulary and text that has it."""
    low = rows.select(*KEY, F.lower("text").alias("__low"))
    found = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    return low.select(*KEY, F.explode(found).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """KEY and the kinds of those rules of which a clause has all its trigrams in the text."""
    listed = [(k, r.kind, t, len(c)) for r in rules for k, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in c]
    clauses = rows.sparkSession.createDataFrame(listed, "clause int, kind string, trigram string, size int")  # a few rows a rule
    index = postings(rows, sorted({t for *_, t, _ in listed}))
    met = index.join(F.broadcast(clauses), "trigram").groupBy(*KEY, "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n"))
    return met.where(F.col("n") == F.col("size")).groupBy(*KEY).agg(F.collect_set("kind").alias("__kinds"))


def java_pattern(rule: Rule) -> str:
    return f"(?{'i' * rule.any_case}:{rule.pattern})"


def matches(rows: DataFrame, rule: Rule) -> DataFrame:
    """KEY, position, length of what precedes a match after the last one, of the match, and of what must have a least length."""
    # \G ties each search to the end of the last match, so that the whole text is read once.
    pattern = F.lit(rf"\G((?s:.*?))({java_pattern(rule)})")
    gaps, whole, valued = (F.regexp_extract_all("text", pattern, F.lit(k)) for k in (1, 2, 2 + rule.group))
    each = rows.select(*KEY, F.posexplode(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), valued.alias("value"))).alias("__at", "__m"))
    return each.select(*KEY, F.lit(rule.kind).alias("kind"), "__at", F.length("__m.gap").alias("__gap"), F.length("__m.whole").alias("__size"), F.length("__m.value").alias("__value"))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __text_hash, kind, start and end of every span."""
    rows = keyed(docs, id_col, text_col)
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ANYTHING)
    parts = []
    if indexed:
        # Written, so that Spark knows its size and broadcasts it only if that is small.
        near = cut(candidates(rows, indexed))
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__text_hash") == F.col("b.__text_hash"))
        chosen = cut(rows.alias("a").join(near.alias("b"), same).select("a.*", "b.__kinds"))
        parts += [matches(chosen.where(F.array_contains("__kinds", r.kind)), r) for r in indexed]
    for rule in rules:
        if rule not in indexed:
            # A plain search first: the slower one that yields positions then sees only texts with a match.
            enough = rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if rule.pattern.endswith("]+") and rule.least else rule.pattern
            parts.append(matches(rows.where(F.col("text").rlike(f"(?{'i' * rule.any_case}:{enough})")), rule))
    found = functools.reduce(DataFrame.unionByName, parts).dropDuplicates([*KEY, "kind", "__at"])
    least = F.lit(0)
    for r in rules:
        least = F.when(F.col("kind") == r.kind, F.lit(r.least)).otherwise(least)
    from pyspark.sql import Window

    before = Window.partitionBy(*KEY, "kind").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("end", F.sum(F.col("__gap") + F.col("__size")).over(before))
    return placed.where(F.col("__value") >= least).select(*KEY, "kind", (F.col("end") - F.col("__size")).alias("start"), "end")


def listing(rules: tuple[Rule, ...]) -> Column:
    """The spans of a group as kind:start:end, by start and then the rules' order, comma-joined."""
    rank = F.lit(len(RULES))
    for k, r in enumerate(RULES):
        rank = F.when(F.col("kind") == r.kind, F.lit(k)).otherwise(rank)
    wanted = F.col("kind").isin([r.kind for r in rules])
    entry = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("shown"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(wanted, entry))), lambda x: x["shown"]), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base and spans (comma-joined listings)."""
    counted = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    by_text = find_spans(docs, RULES, id_col, text_col).groupBy(*KEY).agg(*counted, listing(BASE_RULES).alias("base"), listing(RULES).alias("spans"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__text_hash") == F.col("b.__text_hash"))
    rows = keyed(docs, id_col, text_col).select(*KEY)
    joined = rows.alias("a").join(by_text.alias("b"), same, "left")
    numbers = [F.coalesce(f"b.n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return joined.select("a.doc_id", *numbers, *[F.coalesce(f"b.{c}", F.lit("")).alias(c) for c in ("base", "spans")])


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their own columns, each maximal run of overlapping spans in the text replaced by mark."""
    from pyspark.sql import Window

    spans = find_spans(docs, rules, id_col, text_col)
    order = Window.partitionBy(*KEY).orderBy("start", "end", "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("__new", (F.col("start") >= F.coalesce(reached, F.lit(0))).cast("int"))
    runs = fresh.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*KEY, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_text = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__runs"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"))
    same = F.col("a.id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.__text_hash"))
    joined = source.alias("a").join(by_text.alias("b"), same, "left")
    text, runs_col = F.col(f"a.row.`{text_col}`"), F.col("b.__runs")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(runs_col)),
        lambda k: F.substring(
            text,
            F.coalesce(F.get(runs_col, k - 1)["end"], F.lit(0)).cast("int") + 1,
            F.coalesce(F.get(runs_col, k)["start"], F.length(text)).cast("int") - F.coalesce(F.get(runs_col, k - 1)["end"], F.lit(0)).cast("int"),
        ),
    )
    clean = F.when(runs_col.isNull(), text).otherwise(F.array_join(kept, mark))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"a.row.`{c}`").alias(c) for c in docs.columns])
