"""Substring deduplication by hashing lines and the sentences of lines.

Units are lines (ended by a line feed) of at least `min_line_words` words, and sentences (ended by `.`, `!` or `?` before
white space) of at least `min_sentence_words` words. A unit is normalised (compatible Unicode forms, lower case, white space
runs as one space; sentences without their closing punctuation) and hashed to 128 bits. A line of one sentence is that
sentence, too, so a passage is found as a line of its own and within a longer line. Digests are grouped over all documents;
the occurrence with the least (doc_id, offset) stays and every other one is removed, a line with its line feed. Original
offsets (code points, ends exclusive) are kept with what is removed.

No group is ever collected: digests are pre-aggregated to their first occurrence and count; the few digests with over a
ten-thousandth of all units (at most ten thousand, so small enough to broadcast) are matched by a broadcast join, the
others by a shuffled one in which no key holds more than that share, and of which Spark splits large partitions.

Defined cases: null texts stay null and empty ones empty; rows with the same id and text are one document and share their
result, rows with the same id and other texts are ranked by offset and then by text hash; a null id ranks first; a very
long text is read line by line; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, cut, map_batches

KEY = ["doc_id", "__h"]
SENTENCE_END = re.compile(r"[.!?]+(?=\s)")
UNITS = "start long, end long, high long, low long"


def normalised(unit: str) -> str:
    return " ".join((unit if unit.isascii() else unicodedata.normalize("NFKC", unit)).lower().split())


def digest(unit: str) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(unit.encode())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def units(text: str, min_line_words: int, min_sentence_words: int) -> Iterator[tuple[int, int, int, int]]:
    """start, end and digest of each unit."""
    start = 0
    while start < len(text):
        stop = text.find("\n", start)
        end = len(text) if stop < 0 else stop + 1
        line = text[start:end]
        clean = normalised(line)
        pieces, at = [], 0
        for stop_at in [*(m.end() for m in SENTENCE_END.finditer(line)), len(line)]:
            if line[at:stop_at].strip():
                pieces.append((at, stop_at))
            at = stop_at
        as_sentence = False
        for at, stop_at in pieces:
            sentence = clean if len(pieces) == 1 else normalised(line[at:stop_at])
            sentence = sentence.rstrip(".!? ")
            if sentence and sentence.count(" ") + 1 >= min_sentence_words:
                as_sentence = len(pieces) == 1
                span = (start, end) if as_sentence else (start + at, start + at + len(line[at:stop_at].rstrip()))
                yield *span, *digest("s:" + sentence)
        # Lines that equal an ASCII line of one sentence have one sentence, too, so that the sentence is enough.
        if not (as_sentence and line.isascii()) and clean and clean.count(" ") + 1 >= min_line_words:
            yield start, end, *digest(clean)
        start = end


def find_units(docs: DataFrame, min_line_words: int, min_sentence_words: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("__h"), text.alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                of_text = list(units(text, min_line_words, min_sentence_words))
                rows += [k] * len(of_text)
                found += of_text
            columns = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows, pa.int64())) for c in KEY] + [pa.array(c, pa.int64()) for c in columns], names=[*KEY, "start", "end", "high", "low"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, split, f"doc_id {kind}, __h long, {UNITS}")


def find_repeats(docs: DataFrame, min_line_words: int = 4, min_sentence_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __h, start and end of each unit to remove, and the document of the occurrence that stays."""
    bounded_batches(docs.sparkSession)
    found = cut(find_units(docs, min_line_words, min_sentence_words, id_col, text_col))
    place = F.struct("doc_id", "start", "__h")
    repeated = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = cut(repeated)
    many = max(1000, found.count() // 10_000)
    columns = [*[F.col(c) for c in KEY], "start", "end", F.col("first.doc_id").alias("first_doc_id")]
    later = ~F.struct("doc_id", "start", "__h").eqNullSafe(F.col("first"))
    hot = found.join(F.broadcast(repeated.where(F.col("n") > many)), ["high", "low"]).where(later).select(*columns)
    rest = found.join(repeated.where(F.col("n") <= many), ["high", "low"]).where(later).select(*columns)
    return hot.unionByName(rest).distinct()


def deduplicate(docs: DataFrame, min_line_words: int = 4, min_sentence_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, text without repeats, n_removed, removed_chars and removed.

    removed: start, end (in the original text, overlapping units merged) and first_doc_id of each removed stretch.
    """
    repeats = find_repeats(docs, min_line_words, min_sentence_words, id_col, text_col)
    by_text = repeats.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias("units"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("__h"), F.col(text_col).alias("text"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__h") == F.col("b.__h"))
    joined = source.alias("a").join(by_text.alias("b"), same, "left").select("a.doc_id", "a.text", "b.units")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", batch.schema.field("doc_id").type)])
            texts, spans = [], []
            for text, of_text in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist(), strict=True):
                merged: list[dict] = []
                for u in of_text or []:
                    if merged and u["start"] < merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], u["end"])
                    else:
                        merged.append(dict(u))
                kept, at = [], 0
                for u in merged:
                    kept.append(text[at : u["start"]])
                    at = u["end"]
                texts.append("".join([*kept, text[at:]]) if merged else text)
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))],
                names=["doc_id", "text", "removed"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    out = map_batches(joined, clean, f"doc_id {kind}, text string, removed array<struct<start:long,end:long,first_doc_id:{kind}>>")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), "removed")
