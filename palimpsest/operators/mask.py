"""Masking a table: a projection with some columns replaced, a gate that counts what went wrong, and a staged write.

Applying takes one pass: the staged write itself counts what the gate would, and the copy is moved to its place only if
nothing went wrong. With a seed map, stored replacements come before made ones.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palimpsest.functions import predicates
from palimpsest.functions.strategies import get_strategy, masked, output_type_ok, valid
from palimpsest.operators import seedmap
from palimpsest.operators.profile import quote
from palimpsest.sources import files
from palimpsest.sql import SPARK

MARKER = "_applied.json"  # readers of Parquet skip names that begin with an underscore


@dataclass(frozen=True)
class ColumnPlan:
    column: str
    strategy: str
    rule: str | None = None
    null_markers: tuple[str, ...] = ()


@dataclass
class MaskResult:
    rows: int
    columns: list[str]
    skipped_columns: list[str]
    preview: list[dict] = field(default_factory=list)


class MaskError(RuntimeError):
    """A table that can't be masked as planned. The message names columns and counts, never values."""


def preflight(df: DataFrame, plans: list[ColumnPlan], keys: list[str], read_only: dict[str, str] | None = None) -> tuple[list[ColumnPlan], list[str]]:
    """The plans to carry out, with columns named as in df, and the planned key columns, which are left as they are;
    MaskError before anything runs."""
    columns, kinds = {c.lower(): c for c in df.columns}, dict(df.dtypes)
    if len({p.column.lower() for p in plans}) < len(plans):
        raise MaskError("a column is planned twice")
    for p in plans:
        if p.column.lower() not in columns:
            raise MaskError(f"unknown column {p.column}")
        if p.column.lower() in {c.lower() for c in read_only or {}}:
            raise MaskError(f"column {p.column} can't be written")
        strategy = get_strategy(p.strategy)
        if strategy.column is None and not output_type_ok(strategy, kinds[columns[p.column.lower()]]):
            raise MaskError(f"strategy {p.strategy} doesn't fit column {p.column} of type {kinds[columns[p.column.lower()]]}")
    for k in keys:
        if k.lower() not in columns:
            raise MaskError(f"unknown key {k}")
    kept = {k.lower() for k in keys}
    resolved = [replace(p, column=columns[p.column.lower()]) for p in plans]
    return [p for p in resolved if p.column.lower() not in kept], [p.column for p in resolved if p.column.lower() in kept]


def _is_marker(plan: ColumnPlan) -> Column:
    return F.expr(predicates.marker(SPARK, f"CAST({quote(plan.column)} AS STRING)", list(plan.null_markers)))


def replacement(plan: ColumnPlan, kind: str, seed: str) -> Column:
    """The new value: null for a marker of null and for what the strategy can't replace, else what it makes."""
    strategy = get_strategy(plan.strategy)
    made = masked(strategy, plan.column, kind, seed)
    if strategy.valid is not None:
        made = F.when(valid(strategy, plan.column, kind), made)
    return F.when(~_is_marker(plan), made) if plan.null_markers else made


def _resolved(df: DataFrame, plans: list[ColumnPlan]) -> list[ColumnPlan]:
    """The plans with columns named as in df."""
    columns = {c.lower(): c for c in df.columns}
    return [replace(p, column=columns[p.column.lower()]) for p in plans]


def mask(df: DataFrame, plans: list[ColumnPlan], seed: str) -> DataFrame:
    """df with the planned columns replaced, in one projection; it is stateless, so it also works on a stream."""
    kinds = dict(df.dtypes)
    new = {p.column: replacement(p, kinds[p.column], seed) for p in _resolved(df, plans)}
    return df.select(*[new[c].alias(c) if c in new else F.col(quote(c)) for c in df.columns])


def _unchanged(before: Column, after: Column) -> Column:
    text = before.cast("string")
    return F.coalesce(text.rlike(r"\S") & (F.lower(text) == F.lower(after.cast("string"))), F.lit(False))


def _counters(plans: list[ColumnPlan], kinds: dict[str, str], after: list[Column]) -> list[Column]:
    """rows, and for each plan invalid (values its strategy can't replace) and unchanged; after: what would be written."""
    out = [F.count("*").alias("rows")]
    for k, p in enumerate(plans):
        ok, marker = valid(get_strategy(p.strategy), p.column, kinds[p.column]), _is_marker(p)
        out.append(F.count_if(~ok & ~marker).alias(f"invalid{k}"))
        out.append(F.count_if(ok & ~marker & _unchanged(F.col(quote(p.column)), after[k])).alias(f"unchanged{k}"))
    return out


def gate(df: DataFrame, plans: list[ColumnPlan], seed: str) -> DataFrame:
    """One row for each planned column: rows, invalid (values its strategy can't replace) and unchanged."""
    plans, kinds = _resolved(df, plans), dict(df.dtypes)
    counters = _counters(plans, kinds, [replacement(p, kinds[p.column], seed) for p in plans])
    rows = [F.struct(F.lit(p.column).alias("column_name"), F.col("rows"), F.col(f"invalid{k}").alias("invalid"), F.col(f"unchanged{k}").alias("unchanged")) for k, p in enumerate(plans)]
    return df.agg(*counters).select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def _refuse(plans: list[ColumnPlan], counts: dict) -> None:
    for k, p in enumerate(plans):
        invalid, unchanged = counts[f"invalid{k}"], counts[f"unchanged{k}"]
        if invalid or unchanged:
            raise MaskError(f"column {p.column}: {invalid} values can't be replaced, {unchanged} would stay")


def check_gate(df: DataFrame, plans: list[ColumnPlan], seed: str, pairs: seedmap.SeedMap | None = None) -> int:
    """Rows of df; MaskError if a value can't be replaced or would stay."""
    plans, kinds = _resolved(df, plans), dict(df.dtypes)
    if not plans:
        return df.count()
    both, names = _with_replacements(df, plans, seed, pairs)
    counts = both.agg(*_counters(plans, kinds, [F.col(n) for n in names])).first().asDict()
    _refuse(plans, counts)
    return counts["rows"]


def _with_replacements(df: DataFrame, plans: list[ColumnPlan], seed: str, pairs: seedmap.SeedMap | None) -> tuple[DataFrame, list[str]]:
    """df with a column for each plan's new value, and these columns' names. Stored replacements come first; a marker of
    null never asks the map."""
    kinds, taken = dict(df.dtypes), {c.lower() for c in df.columns}
    names = []
    for p in plans:
        name = f"__new_{len(names)}"
        while name in taken:
            name += "_"
        names.append(name)
    out = df.select("*", *[replacement(p, kinds[p.column], seed).alias(n) for p, n in zip(plans, names, strict=True)])
    for p, name in zip(plans, names, strict=True):
        if pairs is not None and pairs.tracks(p.strategy):
            stored = f"{name}_stored"
            out = pairs.lookup(out, p.column, seedmap.scope(p.strategy), stored)
            found = F.expr(f"try_cast({quote(stored)} AS {kinds[p.column]})")
            chosen = F.coalesce(F.when(~_is_marker(p), found), F.col(name))
            out = out.select(*[chosen.alias(name) if c == name else F.col(quote(c)) for c in out.columns if c != stored])
    return out, names


def remember(df: DataFrame, plans: list[ColumnPlan], seed: str, pairs: seedmap.SeedMap) -> int:
    """Store the replacements of values that the map doesn't know. How many were new."""
    kinds, total = dict(df.dtypes), 0
    for p in _resolved(df, plans):
        if pairs.tracks(p.strategy):
            made = replacement(p, kinds[p.column], seed).cast("string")
            text = F.col(quote(p.column)).cast("string")
            wanted = F.col(quote(p.column)).isNotNull() & ~_is_marker(p) & valid(get_strategy(p.strategy), p.column, kinds[p.column]) & ~_unchanged(F.col(quote(p.column)), made)
            total += pairs.record(df.where(wanted).select(text.alias("value"), made.alias("masked_value")), seedmap.scope(p.strategy), p.strategy)
    return total


def dry_run(df: DataFrame, plans: list[ColumnPlan], keys: list[str], seed: str, preview: int = 10, read_only: dict[str, str] | None = None, pairs: seedmap.SeedMap | None = None, show_values: bool = False) -> MaskResult:
    """What applying would do, with a few rows, each before (letters and digits as asterisks, unless show_values) and
    after. Nothing is written, to the seed map neither, but its pairs are used."""
    todo, skipped = preflight(df, plans, keys, read_only)
    rows = check_gate(df, todo, seed, pairs)
    shown = []
    if todo and preview:
        both, names = _with_replacements(df, todo, seed, pairs)
        texts = [f"CAST({quote(p.column)} AS STRING)" for p in todo]
        before = [F.expr(t if show_values else get_strategy("redact").mask(SPARK, t, "")).alias(f"b{k}") for k, t in enumerate(texts)]
        for r in both.limit(preview).select(*before, *[F.col(n).alias(f"a{k}") for k, n in enumerate(names)]).collect():
            shown.append({p.column: (r[f"b{k}"], r[f"a{k}"]) for k, p in enumerate(todo)})
    return MaskResult(rows, [p.column for p in todo], skipped, shown)


def applied_before(df: DataFrame, path: str, tag: str) -> MaskResult | None:
    """What an earlier call of apply() with that tag did at path, if it came to its end."""
    text = files.read_text(df.sparkSession, f"{path.rstrip('/')}/{MARKER}")
    if text is None:
        return None
    found = json.loads(text)
    return MaskResult(found["rows"], found["columns"], found["skipped"]) if found["tag"] == tag and tag else None


def apply(df: DataFrame, plans: list[ColumnPlan], keys: list[str], seed: str, path: str, read_only: dict[str, str] | None = None, pairs: seedmap.SeedMap | None = None, tag: str = "", replace_old: bool = False) -> MaskResult:
    """Write the masked copy: to a staging folder beside the path, which then is renamed, so that no half of it is seen.

    The staged write counts values that couldn't be replaced or stayed; if there are any, it is deleted again. tag: names
    the attempt; a later call with the same one finds that a call which broke off after the rename was complete.
    replace_old: put the copy in place of an existing one, which goes only then.
    """
    if plans and not keys:
        raise MaskError("a table without a key can't be masked for good")
    todo, skipped = preflight(df, plans, keys, read_only)
    spark, path = df.sparkSession, path.rstrip("/")
    if files.exists(spark, path):
        done = applied_before(df, path, tag)
        if done is not None:
            return done
        if not replace_old:
            raise MaskError("the target exists")
    if pairs is not None:
        remember(df, todo, seed, pairs)
    both, names = _with_replacements(df, todo, seed, pairs)
    seen = Observation()
    counted = both.observe(seen, *_counters(todo, dict(df.dtypes), [F.col(n) for n in names]))
    new = dict(zip((p.column for p in todo), names, strict=True))
    staging = f"{path}__staging"
    counted.select(*[F.col(new[c]).alias(c) if c in new else F.col(quote(c)) for c in df.columns]).write.mode("overwrite").parquet(staging)
    counts = seen.get
    try:
        _refuse(todo, counts)
    except MaskError:
        files.delete(spark, staging)
        raise
    result = MaskResult(counts["rows"], [p.column for p in todo], skipped)
    files.write_text(spark, f"{staging}/{MARKER}", json.dumps({"tag": tag, "rows": result.rows, "columns": result.columns, "skipped": skipped}))
    if files.exists(spark, path):
        files.delete(spark, f"{path}__old")
        files.rename(spark, path, f"{path}__old")
    files.rename(spark, staging, path)
    files.delete(spark, f"{path}__old")
    return result


def fingerprint(df: DataFrame) -> DataFrame:
    """A fingerprint of a table's rows in any order: their number, and the sum and the exclusive or of their hashes."""
    h = F.xxhash64(*[F.col(quote(c)) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def version_fingerprint(df: DataFrame, keys: list[str], upto: int | None = None) -> DataFrame:
    """A fingerprint of rows and of their order by key: one row, rows and digest. upto: of the first rows by key only.

    Rows are placed by a range partitioning and hashed with their place, and the hashes are added up, so that no task
    holds the table.
    """
    h = F.sha2(F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    ordered = placed(df.select(*[F.col(quote(k)) for k in keys], h.alias("__version")), keys)
    if upto is not None:
        ordered = ordered.where(F.col("place") <= upto)
    each = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("place").cast("string"), "__version"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return ordered.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest"))


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with place, each row's number in the order of the keys from 1.

    Rows are dealt by ranges of the key and numbered within their range; what precedes a range is a count for each one.
    """
    listed = [F.col(quote(k)) for k in keys]
    ranged = df.repartitionByRange(*listed).sortWithinPartitions(*listed).withColumn("__id", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    order = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))  # a row for each partition
    return ranged.join(F.broadcast(before), "__part").select(*[F.col(quote(c)) for c in df.columns], (F.col("__before") + F.col("__at") + 1).alias("place"))
