"""The seed map: remembered replacements, so that they outlive changes of seeds and dictionaries. Originals aren't kept,
only salted hashes of them. A pair is (scope, value_hash) and is never rewritten: what is stored first wins.
"""

from __future__ import annotations

import json
import secrets

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.strategies import Strategy, get_strategy
from palimpsest.operators.profile import quote
from palimpsest.sources import files

SCHEMA = "seed string, scope string, value_hash string, masked_value string, strategy string, created_at timestamp"
UNTRACKED = ("null", "blank", "redact")


def scope(strategy: Strategy | str, date_order: str = "MDY") -> str:
    """What pairs are valid for: the strategy, in its form's version."""
    strategy = get_strategy(strategy) if isinstance(strategy, str) else strategy
    parts = [strategy.name, strategy.version, date_order if strategy.name == "fake_date" else ""]
    return ":".join(p for p in parts if p)


def value_hash(salt: str, scope_name: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}|{scope_name}|"), value.cast("string")), 256)


class SeedMap:
    """A folder with the pairs (Parquet, a folder for each scope) and a sidecar with the salt, on any file system Spark
    can reach. untracked: strategies whose pairs aren't kept."""

    def __init__(self, spark: SparkSession, path: str, salt: str | None = None, untracked: tuple[str, ...] = UNTRACKED):
        self.spark, self.path, self.untracked = spark, path.rstrip("/"), tuple(u.lower() for u in untracked)
        self.salt = salt if salt is not None else self._stored_salt()

    def _stored_salt(self) -> str:
        """A salt made once and kept; a configured one is never stored."""
        at = f"{self.path}/meta.json"
        if files.read_text(self.spark, at) is None:
            files.write_text(self.spark, at, json.dumps({"salt": secrets.token_hex(16)}))
        return json.loads(files.read_text(self.spark, at))["salt"]

    def tracks(self, strategy: str) -> bool:
        return strategy.lower() not in self.untracked

    def pairs(self) -> DataFrame:
        if not files.exists(self.spark, f"{self.path}/pairs"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/pairs")

    def count(self) -> int:
        return self.pairs().count()

    def all_pairs(self, limit: int = 100) -> DataFrame:
        return self.pairs().orderBy("created_at", "scope", "value_hash").limit(limit)

    def lookup(self, df: DataFrame, column: str, scope_name: str, name: str = "stored") -> DataFrame:
        """df with the stored replacement of column's value, null where there is none; a left join on the hash.

        Nulls have no pair: each joins by a key of its row's own, so that they don't meet in one task.
        """
        mine = self.pairs().where(F.col("scope") == scope_name).select("value_hash", "masked_value")
        own = F.concat(F.lit("-"), F.xxhash64(*[F.col(quote(c)) for c in df.columns]).cast("string"))
        keyed = df.select(F.struct(*[F.col(quote(c)) for c in df.columns]).alias("row"), F.coalesce(value_hash(self.salt, scope_name, F.col(quote(column))), own).alias("value_hash"))
        return keyed.join(mine, "value_hash", "left").select("row.*", F.col("masked_value").alias(name))

    def fresh(self, new: DataFrame, scope_name: str, strategy: str) -> DataFrame:
        """The pairs of new (value, masked_value) whose hash isn't stored; of several for a value the least stays."""
        h = value_hash(self.salt, scope_name, F.col("value"))
        one = new.where("value IS NOT NULL AND masked_value IS NOT NULL AND masked_value <> ''").groupBy(h.alias("value_hash")).agg(F.min("masked_value").alias("masked_value"))
        stored = self.pairs().where(F.col("scope") == scope_name).select("value_hash")
        return one.join(stored, "value_hash", "left_anti").select(
            F.substring("value_hash", 1, 16).alias("seed"), F.lit(scope_name).alias("scope"), "value_hash", "masked_value", F.lit(strategy).alias("strategy"), F.current_timestamp().alias("created_at")
        )

    def record(self, new: DataFrame, scope_name: str, strategy: str) -> int:
        """Append fresh(); how many pairs these are. One writer at a time."""
        with files.lock(self.spark, f"{self.path}/writer.lock"):
            seen = Observation()
            rows = self.fresh(new, scope_name, strategy).observe(seen, F.count("*").alias("n"))
            rows.write.mode("append").partitionBy("scope").parquet(f"{self.path}/pairs")
            return seen.get["n"]


def mask_with(df: DataFrame, column: str, strategy: str, seed: str, pairs: SeedMap, write: bool = True) -> DataFrame:
    """df with column masked: stored replacements first, made ones otherwise; these are recorded unless write is False.

    For a whole plan, with the gate and its checks, see mask.apply().
    """
    from palimpsest.operators import mask  # which uses this module

    plan = [mask.ColumnPlan(column, strategy)]
    if write:
        mask.remember(df, plan, seed, pairs)
    both, (name,) = mask._with_replacements(df, plan, seed, pairs)
    return both.select(*[F.col(name).alias(c) if c.lower() == column.lower() else F.col(quote(c)) for c in df.columns])
