"""Checks of a masked copy against its source. Issues carry counts and names, never values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import predicates
from palimpsest.operators.profile import quote
from palimpsest.sql import SPARK

PASS, FAIL, WARNING, SKIPPED, ERROR = "pass", "fail", "warning", "skipped", "error"


@dataclass(frozen=True)
class Issue:
    check: str
    status: str
    table: str = ""
    column: str = ""
    message: str = ""
    detail: dict = field(default_factory=dict)


@dataclass
class TableMeta:
    """What Parquet doesn't know of a table."""

    keys: list[str] = field(default_factory=list)
    generated: list[str] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    foreign_keys: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)


def is_test_data(column: Column | str) -> Column:
    """For a column's name; the expression of palimpsest.functions.predicates."""
    return F.expr(predicates.test_data(SPARK, f"CAST({quote(column)} AS STRING)"))


def counted(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: source_rows, target_rows, difference and status."""
    both = source.select(F.lit(1).alias("s")).unionByName(target.select(F.lit(0).alias("s")))
    counts = both.agg(F.count_if(F.col("s") == 1).alias("source_rows"), F.count_if(F.col("s") == 0).alias("target_rows"))
    difference = F.col("target_rows") - F.col("source_rows")
    return counts.withColumns({"difference": difference, "status": F.when(difference == 0, PASS).otherwise(FAIL)})


def row_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> list[Issue]:
    out = []
    for name in sorted(source.keys() & target.keys()):
        try:
            r = counted(source[name], target[name]).first()
        except Exception as e:  # the text may hold values
            out.append(Issue("row_count", ERROR, name, message=type(e).__name__))
            continue
        out.append(Issue("row_count", r["status"], name, detail={"source": r["source_rows"], "target": r["target_rows"], "difference": r["difference"]}))
    return out


def unmatched(source: DataFrame, target: DataFrame) -> DataFrame:
    """Names (table_name) on one side only, and which side that is."""
    left = source.join(target, "table_name", "left_anti").withColumn("side", F.lit("source"))
    return left.unionByName(target.join(source, "table_name", "left_anti").withColumn("side", F.lit("target")))


def presence(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> list[Issue]:
    out = [Issue("tables", WARNING, name, message="only in the source") for name in sorted(source.keys() - target.keys())]
    return out + [Issue("tables", WARNING, name, message="only in the target") for name in sorted(target.keys() - source.keys())]


def schema_elements(name: str, source: DataFrame, target: DataFrame, source_meta: TableMeta | None = None, target_meta: TableMeta | None = None) -> list[Issue]:
    """One issue for each of columns (with types), keys, indexes, foreign keys, unique sets and checks."""
    a, b = source_meta or TableMeta(), target_meta or TableMeta()
    pairs = {"columns": (sorted(source.dtypes), sorted(target.dtypes)), "primary_key": (sorted(a.keys), sorted(b.keys))}
    pairs |= {k: (sorted(getattr(a, k)), sorted(getattr(b, k))) for k in ("indexes", "foreign_keys", "unique", "checks")}
    return [Issue("schema", PASS if x == y else FAIL, name, message=k, detail={"source_only": [str(i) for i in x if i not in y], "target_only": [str(i) for i in y if i not in x]}) for k, (x, y) in pairs.items()]


def aligned(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], limit: int | None = None, ignore_test_data: bool = True) -> DataFrame:
    """A row for each column: source_rows, target_rows, source_only, target_only, compared and unmasked.

    One full outer join on the key compares all columns together. limit: of rows on each side, the first by key.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        if limit is not None:
            df = df.orderBy(*keys).limit(limit)
        return df.select(*[F.col(quote(k)).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(quote(c)).alias(f"{prefix}{i}") for i, c in enumerate(columns)], F.lit(True).alias(f"{prefix}_here"))

    on = [f"k{i}" for i in range(len(keys))]
    both = side(source, "s").join(side(target, "t"), on, "full_outer")
    here = F.col("s_here").isNotNull() & F.col("t_here").isNotNull()
    aggregates = [
        F.count("s_here").alias("source_rows"),
        F.count("t_here").alias("target_rows"),
        F.count_if(F.col("t_here").isNull()).alias("source_only"),
        F.count_if(F.col("s_here").isNull()).alias("target_only"),
    ]
    for i in range(len(columns)):
        counts = here & F.col(f"s{i}").isNotNull()
        if ignore_test_data:
            counts = counts & ~is_test_data(f"s{i}")
        aggregates += [F.count_if(counts).alias(f"compared{i}"), F.count_if(counts & F.col(f"s{i}").eqNullSafe(F.col(f"t{i}"))).alias(f"unmasked{i}")]
    rows = [F.struct(F.lit(c).alias("column_name"), "source_rows", "target_rows", "source_only", "target_only", F.col(f"compared{i}").alias("compared"), F.col(f"unmasked{i}").alias("unmasked")) for i, c in enumerate(columns)]
    return both.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def outcome(partial: Column) -> Column:
    """The status of a row of aligned(), the first that applies."""
    mismatch = (F.col("source_only") > 0) | (F.col("target_only") > 0)
    return (
        F.when(F.col("unmasked") > 0, FAIL)
        .when(mismatch, F.when(partial, WARNING).otherwise(FAIL))
        .when(F.col("compared") == 0, SKIPPED)
        .when(partial, WARNING)
        .otherwise(PASS)
    )


def completeness(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], limit: int | None = 5000, ignore_test_data: bool = True) -> DataFrame:
    """aligned() with the status of each column. Partial if a side has more rows than limit."""
    if not keys:
        raise ValueError("without a key, use overlap()")
    partial = F.lit(False)
    if limit is not None:
        longer = max(source.limit(limit + 1).count(), target.limit(limit + 1).count())
        partial = F.lit(longer > limit)
    return aligned(source, target, keys, columns, limit, ignore_test_data).withColumn("status", outcome(partial))


def failing_rows(source: DataFrame, target: DataFrame, keys: list[str], column: str, most: int = 5) -> DataFrame:
    """The first `most` unmasked rows by key, as random references, their place in the source's order of keys (from 1)
    and asterisks for the value.

    Places are counts of the source's rows up to these few keys, so that nothing is ranked in one task.
    """
    listed = [F.col(quote(k)) for k in keys]
    mine = source.select(F.struct(*listed).alias("k"), F.col(quote(column)).alias("v"))
    other = target.select(F.struct(*listed).alias("k"), F.col(quote(column)).alias("w"))
    same = mine.join(other, "k").where("v IS NOT NULL AND v <=> w")
    first = same.where(~is_test_data("v")).select("k", F.expr("repeat('*', length(CAST(v AS STRING)))").alias("redacted")).orderBy("k").limit(most)
    before = source.select(F.struct(*listed).alias("mine")).join(F.broadcast(first), F.col("mine") <= F.col("k"))  # `most` rows
    return before.groupBy("k", "redacted").agg(F.count("*").alias("place")).select(F.uuid().alias("row_ref"), "place", "redacted")


def comparable_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns of both sides but for binary and nested ones."""
    other = {f.name for f in target.schema.fields}
    return [f.name for f in source.schema.fields if f.name in other and not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]


def _row_digest(df: DataFrame, columns: list[str]) -> Column:
    """128 bits that are equal for equal rows, nulls and both zeros of floats included."""
    kinds, parts = dict(df.dtypes), []
    for c in columns:
        value = F.col(quote(c))
        if kinds[c] in ("float", "double"):
            value = F.when(value == 0, F.lit(0.0).cast(kinds[c])).otherwise(value)
        parts += [value, value.isNull()]
    return F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("l"))


def overlap(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """For tables without a key, one row: shared values of the column (no test data), identical whole rows, and status.

    Only rows with a shared value can be identical; of these, digests are compared, and only rows with a shared digest
    are compared themselves.
    """
    columns = comparable_columns(source, target)
    real = F.col(quote(column)).isNotNull() & ~is_test_data(column)
    value = F.col(quote(column))
    shared = source.where(real).select(value.alias("v")).distinct().join(target.where(real).select(value.alias("v")).distinct(), "v", "left_semi")

    def near(df: DataFrame) -> DataFrame:
        listed = [F.col(quote(c)).alias(f"c{k}") for k, c in enumerate(columns)]
        return df.where(real).select(value.alias("v"), _row_digest(df, columns).alias("digest"), *listed).join(shared, "v", "left_semi")

    digests = near(source).select("digest").distinct().join(near(target).select("digest").distinct(), "digest", "left_semi")
    mine, other = (near(df).join(digests, "digest", "left_semi").drop("v", "digest") for df in (source, target))
    each = shared.agg(F.count("*").alias("n")).select(F.lit("v").alias("kind"), "n").unionByName(mine.intersect(other).agg(F.count("*").alias("n")).select(F.lit("r").alias("kind"), "n"))
    counts = each.agg(F.max(F.when(F.col("kind") == "v", F.col("n"))).alias("shared_values"), F.max(F.when(F.col("kind") == "r", F.col("n"))).alias("identical_rows"))
    status = F.when(F.col("shared_values") == 0, PASS).when(F.lit(len(columns) < 2), WARNING).when(F.col("identical_rows") > 0, FAIL).otherwise(WARNING)
    return counts.select("shared_values", "identical_rows", status.alias("status"))


def summary(issues: DataFrame) -> DataFrame:
    """Counts by status, and whether all passed: strictly, warnings and skipped checks count against it."""
    return issues.agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (PASS, FAIL, WARNING, SKIPPED, ERROR)],
        (~F.coalesce(F.bool_or(F.col("status").isin(FAIL, ERROR)), F.lit(False))).alias("passed"),
        (~F.coalesce(F.bool_or(F.col("status") != PASS), F.lit(False))).alias("passed_strict"),
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child without their parent."""
    return child.join(parent.select(F.col(quote(parent_key)).alias(child_key)), child_key, "left_anti")


def disagreeing(left: DataFrame, right: DataFrame, on: tuple[str, str], columns: tuple[str, str]) -> DataFrame:
    """Pairs of rows that belong together and whose columns differ (null equals null)."""
    a = left.select(F.col(quote(on[0])).alias("k"), F.col(quote(columns[0])).alias("a"))
    b = right.select(F.col(quote(on[1])).alias("k"), F.col(quote(columns[1])).alias("b"))
    return a.join(b, "k").where(~F.col("a").eqNullSafe(F.col("b")))


def coverage(decisions: DataFrame, selected: DataFrame) -> DataFrame:
    """decisions (column_name, sensitivity, maybe source) that aren't all covered by selected (column_name): column_name
    and status. What is undecided passes if it is selected, unless its review is pending."""
    pending = F.col("source") == "history_pending" if "source" in decisions.columns else F.lit(False)
    left = decisions.join(selected.distinct().withColumn("__selected", F.lit(True)), "column_name", "left")
    status = (
        F.when(F.col("sensitivity") == "error", ERROR)
        .when((F.col("sensitivity") == "unknown") & pending, WARNING)
        .when(F.col("__selected"), PASS)
        .when(F.col("sensitivity") == "not_sensitive", PASS)
        .otherwise(WARNING)
    )
    return left.select("column_name", status.alias("status"))
