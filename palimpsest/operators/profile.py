"""Sampling and evidence: which kind of value each column holds, in one pass over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import predicates
from palimpsest.functions.predicates import NEED_CONTEXT, NEED_CONTEXT_AS_DIGITS, Pattern, column_hints, default_patterns
from palimpsest.sql import SPARK

UNSUPPORTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)


def quote(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def supported_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, UNSUPPORTED)]


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and value (text, not null) of every cell."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    cells = ", ".join(f"'{c.replace(chr(39), chr(92) + chr(39))}', CAST({quote(c)} AS STRING)" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {cells})").alias("column_name", "value")).where("value IS NOT NULL")


SPARE = 8  # how many times the values that are wanted may pass the first cut


def sample_values(df: DataFrame, columns: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Up to `limit` distinct values of each column: the first by their SHA-256, so that every run samples the same.

    A first pass estimates each column's number of distinct values. Of columns with many, only values go on whose hash is
    below a bound that SPARE times `limit` of them are expected to pass, so that few cells are shuffled and ranked. (Were
    an estimate eight times too high, fewer values than `limit` would be sampled; its standard error is a twentieth.)
    """
    columns = columns if columns is not None else supported_columns(df)
    if not columns:
        return unpivoted(df, columns)
    estimates = df.agg(*[F.approx_count_distinct(F.col(quote(c)).cast("string")).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    bounds = {c: min(1.0, SPARE * limit / max(estimates[k], 1)) for k, c in enumerate(columns)}
    cells = unpivoted(df, columns).withColumn("hash", F.sha2("value", 256))
    if cut := {c: f"{int(b * 0xFFFFFFFF):08x}" for c, b in bounds.items() if b < 1}:
        bound = F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("column_name"))
        cells = cells.where(bound.isNull() | (F.substring("hash", 1, 8) <= bound))
    order = Window.partitionBy("column_name").orderBy("hash", "value")
    return cells.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("column_name", "value")


def evidence(values: DataFrame, types: dict[str, str], patterns: list[Pattern] | None = None, min_ratio: float = 0.9, min_samples: int = 20) -> DataFrame:
    """A row for each column and kind with hits or a hint: hits, total, ratio, threshold, eligible and reasons.

    values: column_name and value; types: Spark's type of each column.
    """
    if not 0 < min_ratio <= 1:
        raise ValueError("min_ratio must be above 0 and at most 1")
    if isinstance(min_samples, bool) or not isinstance(min_samples, int) or min_samples < 1:
        raise ValueError("min_samples must be a whole number from 1")
    patterns = patterns if patterns is not None else default_patterns(min_ratio)
    clean = values.select("column_name", F.expr(predicates.strip(SPARK, "value")).alias("v")).where("v <> ''")
    tests = clean.select("column_name", "v", *[F.expr(p.test(SPARK, "v")).alias(f"t{k}") for k, p in enumerate(patterns)])
    digits = F.col("v").rlike(r"^[0-9]+\z")
    aggregates = [F.count("*").alias("total")]
    for k, p in enumerate(patterns):
        hit = F.col(f"t{k}")
        bare = F.lit(p.name in NEED_CONTEXT)
        if p.name in NEED_CONTEXT_AS_DIGITS:
            bare = F.coalesce(F.bool_or(hit & digits), F.lit(False))
        if p.name == "ssn":
            bare = bare | F.coalesce(F.bool_or(hit & F.col("v").rlike(r"[Xx*]")), F.lit(False))
        aggregates.append(F.struct(F.lit(p.name).alias("name"), F.count_if(hit).alias("hits"), F.lit(float(max(min_ratio, p.min_ratio))).alias("threshold"), bare.alias("context")).alias(f"p{k}"))
    hints = [(c, sorted(column_hints(c, kind))) for c, kind in types.items()]
    context = values.sparkSession.createDataFrame(hints, "column_name string, hints array<string>")  # a row for each column of a table
    known = F.broadcast(context).join(tests.groupBy("column_name").agg(*aggregates), "column_name", "left")
    each = known.select("column_name", "hints", F.coalesce("total", F.lit(0)).alias("total"), F.explode(F.array(*[F.coalesce(f"p{k}", F.struct(F.lit(p.name).alias("name"), F.lit(0).cast("long").alias("hits"), F.lit(float(max(min_ratio, p.min_ratio))).alias("threshold"), F.lit(p.name in NEED_CONTEXT).alias("context"))) for k, p in enumerate(patterns)])).alias("p"))
    flat = each.select("column_name", "hints", "total", "p.*").where((F.col("hits") > 0) | F.array_contains("hints", F.col("name")))
    ratio = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0))
    below, conflict = F.col("ratio") < F.col("threshold"), (F.size("hints") > 0) & (F.col("hints") != F.array("name"))
    lacking = F.col("context") & ~F.array_contains("hints", F.col("name"))
    reasons = F.array_compact(F.array(F.when(below, F.lit("below threshold")), F.when(conflict, F.lit("column or type context conflicts")), F.when(lacking, F.lit("needs column or type context"))))
    judged = flat.withColumn("ratio", ratio).withColumn("reasons", reasons)
    eligible = (F.col("total") >= min_samples) & (F.size("reasons") == 0) & (F.size("hints") <= 1)
    return judged.select("column_name", "name", "hits", "total", "ratio", "threshold", eligible.alias("eligible"), "reasons")


def winners(found: DataFrame, types: dict[str, str], min_samples: int = 20) -> DataFrame:
    """One row per column: the kind if exactly one is eligible, and why not otherwise."""
    counted = found.groupBy("column_name").agg(F.count_if("eligible").alias("n"), F.max(F.when(F.col("eligible"), F.col("name"))).alias("name"), F.max("total").alias("total"))
    columns = found.sparkSession.createDataFrame([(c, len(column_hints(c, k))) for c, k in types.items()], "column_name string, n_hints int")
    all_columns = F.broadcast(columns).join(counted, "column_name", "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    outcome = F.when(n == 1, "match").when(n > 1, "several eligible").when(F.col("n_hints") > 1, "conflicting context").when(total < min_samples, "too few samples").otherwise("inconclusive")
    return all_columns.select("column_name", F.when(n == 1, F.col("name")).alias("kind"), outcome.alias("outcome"), n.cast("long").alias("n_eligible"))
