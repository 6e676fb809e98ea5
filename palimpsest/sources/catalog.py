"""Tables in a folder (Parquet) or from any reader, with what their files don't say: keys, generated columns, constraints."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.profile import quote
from palimpsest.operators.validate import TableMeta
from palimpsest.sources import files


def split(name: str) -> tuple[str, str]:
    """A table's schema and its name there."""
    schema, dot, base = name.rpartition(".")
    return (schema, base) if dot else ("main", name)


def location(path: str, name: str) -> str:
    schema, base = split(name)
    return f"{path.rstrip('/')}/{base}.parquet" if schema == "main" else f"{path.rstrip('/')}/{schema}/{base}.parquet"


class Catalog:
    """Tables of a folder: `name.parquet` in it is table `name` of schema main, `schema/name.parquet` is `schema.name`.

    readers: tables by other means, each a function of no arguments to a DataFrame; describe: instead of meta, a function
    from a table's name to its TableMeta; schemas: the only ones to look at.
    """

    def __init__(self, spark: SparkSession, path: str, meta: dict[str, TableMeta] | None = None, readers: dict[str, Callable[[], DataFrame]] | None = None, name: str = "main", schemas: list[str] | None = None, describe: Callable[[str], TableMeta] | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.meta, self.readers, self.only, self.describe = meta or {}, readers or {}, schemas, describe

    def schemas(self) -> list[str]:
        if self.only:
            return list(self.only)
        found = [n for n in files.listed(self.spark, self.path) if "." not in n and n[:1] != "_"]
        return ["main", *(n for n in found if any(x.endswith(".parquet") for x in files.listed(self.spark, f"{self.path}/{n}")))]

    def tables(self) -> list[str]:
        out = set(self.readers)
        for schema in self.schemas():
            folder, prefix = (self.path, "") if schema == "main" else (f"{self.path}/{schema}", f"{schema}.")
            out |= {prefix + n.removesuffix(".parquet") for n in files.listed(self.spark, folder) if n.endswith(".parquet")}
        return sorted(out)

    def table(self, name: str) -> DataFrame:
        if name in self.readers:
            return self.readers[name]()
        return self.spark.read.parquet(location(self.path, name))

    def meta_of(self, name: str) -> TableMeta:
        return self.describe(name) if self.describe else self.meta.get(name, TableMeta())

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def column_type(self, name: str, column: str) -> str:
        kinds = dict(self.table(name).dtypes)
        if column not in kinds:
            raise KeyError(column)
        return kinds[column]

    def keys(self, name: str) -> list[str]:
        return self.meta_of(name).keys

    def key_holds(self, name: str) -> bool:
        """Whether the declared key really identifies rows."""
        df, keys = self.table(name), self.keys(name)
        return bool(keys) and df.groupBy(*[quote(k) for k in keys]).count().where("count > 1").isEmpty()

    def read_only(self, name: str) -> dict[str, str]:
        return dict.fromkeys(self.meta_of(name).generated, "generated")

    def rows(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.table(name)
        return df.select(*[quote(c) for c in columns]) if columns else df

    def page(self, name: str, limit: int, after: tuple | None = None, columns: list[str] | None = None) -> DataFrame:
        """The next rows by key; after: the key of the last one seen."""
        keys = self.keys(name)
        if not keys:
            raise ValueError("a table without a key has no pages")
        df = self.rows(name, columns)
        if after is not None:
            kinds = dict(df.dtypes)
            last = F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, after, strict=True)])
            df = df.where(F.struct(*[F.col(quote(k)) for k in keys]) > last)
        return df.orderBy(*[quote(k) for k in keys]).limit(limit)

    def distinct_values(self, name: str, column: str, limit: int = 5000) -> DataFrame:
        return self.table(name).select(quote(column)).where(F.col(quote(column)).isNotNull()).distinct().limit(limit)

    def row_counts(self, names: list[str] | None = None) -> DataFrame:
        each = [self.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names or self.tables()]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def elements(self) -> DataFrame:
        """table_name, column_name, data_type, is_key and is_generated of every column."""
        rows = [(t, c, k, c in self.keys(t), c in self.read_only(t)) for t in self.tables() for c, k in self.table(t).dtypes]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_key boolean, is_generated boolean")

    def inventory(self) -> dict:
        """What a frozen plan records of the scope."""
        return {t: {"columns": sorted(self.columns(t)), "primary_key": self.keys(t), "column_types": dict(self.table(t).dtypes), "non_writable": self.read_only(t)} for t in self.tables()}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""CSV in which an unquoted \N is null. The schema is required: guessing types costs a pass and may change keys."""
    return spark.read.schema(schema).option("header", True).option("nullValue", r"\N").option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    r"""As read_csv() reads it. A text \N can't be told from null there; Parquet is the format without loss."""
    df.write.option("header", True).option("nullValue", r"\N").option("quoteAll", False).option("escape", '"').csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def export_pair(before: DataFrame, after: DataFrame, keys: list[str], folder: str) -> dict[str, dict]:
    r"""Both tables as CSV by key in folder/before and folder/after, and a manifest of their files' SHA-256.

    Texts are quoted, a null is an unquoted \N, so the two differ. Refused if the keys of the two sides aren't the same.
    """
    spark, on = before.sparkSession, [F.col(quote(k)) for k in keys]
    if before.columns != after.columns:
        raise ValueError("the two tables have different columns")
    sides = before.select(*on, F.lit(1).alias("__side")).unionByName(after.select(*on, F.lit(-1).alias("__side")))
    if not sides.groupBy(*on).agg(F.sum("__side").alias("__sum"), F.count("*").alias("__n")).where("__sum <> 0 OR __n <> 2").isEmpty():
        raise ValueError("the keys of the two tables don't match row by row")
    manifest = {}
    for name, df in (("before", before), ("after", after)):
        cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(quote(c)).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(r"\N")) for c in df.columns]
        ordered = df.repartitionByRange(*on).sortWithinPartitions(*on)
        ordered.select(F.concat_ws(",", *cells).alias("line")).write.text(f"{folder}/{name}")
        found = spark.read.format("binaryFile").load(f"{folder}/{name}/part-*").select("path", F.sha2("content", 256).alias("sha256"), "length").collect()  # a row for each file
        manifest[name] = {"columns": df.columns, "files": {r["path"].rsplit("/", 1)[-1]: {"sha256": r["sha256"], "bytes": r["length"]} for r in found}}
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    return manifest
