"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 22  # bytes of a part of a very long text
BATCH_BYTES = 8 << 20  # of a batch that Python handles at once
#: What `[\x20\x09-\x0D]` matches; bytes.split() without arguments splits at exactly these.
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a single machine (tests) a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation of what precedes.

    The copy is deleted when the application ends.
    """
    spark = df.sparkSession
    gc.collect()
    spark._jvm.System.gc()  # Spark deletes shuffle files once what refers to them is collected
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(name)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of bounded rows and bytes, from the JVM's side on. Spark reads these settings of
    the session when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def as_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null: null) only, so that no other column can clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def crc_mod(id_col: str, m: int):
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def split_at_space(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """Parts of about `size` bytes (default CHUNK), cut only at ASCII white space, so that a very long text never becomes
    one list of words. What has no white space stays in one part."""
    size, start = size or CHUNK, 0
    while len(data) - start > size:
        end = max(data.rfind(c, start, start + size) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if end < 0:
            found = WHITE.search(data, start + size)
            if not found:
                break
            end = found.start()
        yield data[start:end]
        start = end + 1
    yield data[start:] if start else data


def bounded(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, those over `size` bytes (default BATCH_BYTES) in slices of about that size."""
    size = size or BATCH_BYTES
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def give_back() -> None:
    """Return free memory to the system, as Spark keeps Python workers for later tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded size, after which a worker gives back its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(bounded(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)
