"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z. An item's windows are its
runs of `n` words, or all its words when it has fewer. A document word inside any occurrence of a window is hit.

Only what is proven small is broadcast: the item table is measured first, and beyond `slice_bytes` it is dealt into
slices by hash; the documents then pass through one scan for each slice and no shuffle is needed either way. An index is
made once, by the driver, and takes some twenty bytes for each word of its slice besides the distinct words.

Defined cases: null and empty texts have no words, no hits and are clean; items without words have no window; repeated
rows are kept and each gets its own result; two items with the same words both count; items with a null id hit words like
others, and count as one item, a null, together; an empty item table hits nothing; an empty document table gives no rows;
very long texts are read in parts cut at what separates words, and are matched whole; other columns of either table are
ignored, and kept by decontaminate(), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, map_batches, split_at_space

#: Everything that separates words becomes a space, A-Z become a-z; bytes from 0x80 belong to words.
TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WindowIndex:
    """The windows of some items: all items' words one after another, and by window length the sorted hashes of windows
    with the places where they begin and the items that they are of."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        streams = [
            np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in (text or b"").translate(TO_WORDS).split()], dtype=np.uint32) for _, text in items
        ]
        self.words = np.concatenate([np.zeros(0, dtype=np.uint32), *streams])
        sizes = np.array([len(x) for x in streams], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        widths = np.minimum(n, sizes)
        self.windows = []
        for size in sorted(set(widths[widths > 0].tolist())):
            of = np.flatnonzero(widths == size)
            many = sizes[of] - size + 1
            owner = np.repeat(of, many)
            start = np.repeat(begins[of] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            hashes = window_hashes(self.words, start, size)
            order = np.argsort(hashes, kind="stable")
            self.windows.append((size, hashes[order], start[order].astype(np.uint32), owner[order].astype(np.uint32)))

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[str | None]]:
        """Mark of each word that is hit, and the items whose windows occur."""
        hit = np.zeros(len(ids) + 1, dtype=np.int32)
        items: set[str | None] = set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, hashes, places, owners in self.windows:
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])  # windows made of known words only
            for part in range(0, len(at), 1 << 16):
                starts = at[part : part + (1 << 16)]
                found = window_hashes(ids, starts, size)
                first = np.searchsorted(hashes, found, side="left")
                last = np.searchsorted(hashes, found, side="right")
                for j in np.flatnonzero(first < last):
                    own = ids[starts[j] : starts[j] + size]
                    same = [k for k in range(first[j], last[j]) if np.array_equal(self.words[places[k] : places[k] + size], own)]  # verified
                    if same:
                        hit[starts[j]] += 1
                        hit[starts[j] + size] -= 1
                        items.update(self.items[owners[k]] for k in same)
        return np.cumsum(hit[:-1]) > 0, items


def in_order(items: set[str | None]) -> list[str | None]:
    """By string, a null last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ words[starts + k].astype(np.uint64)) * MULTIPLIER
            out ^= out >> np.uint64(29)
    return out


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def merge(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*old, *new]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.vocabulary.get
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            counts, hits, items = [], [], []
            earlier = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for text, was_hit, had in zip(batch.column("text").to_pylist(), *earlier, strict=True):
                parts = [
                    np.fromiter(map(get, words, repeat(0)), dtype=np.uint32, count=len(words))
                    for piece in split_at_space((text or b"").translate(TO_WORDS))
                    for words in [piece.split()]
                ]
                ids = np.concatenate(parts)
                marks, found = index.scan(ids)
                spans = runs(marks) if marks.any() else []
                counts.append(len(ids))
                hits.append([{"start": a, "end": b} for a, b in merge([(x["start"], x["end"]) for x in was_hit], spans)])
                items.append(in_order({*had, *found}))
            made = {
                "n_words": pa.array(counts, pa.int64()),
                "hits": pa.array(hits, pa.list_(span)),
                "items": pa.array(items, pa.list_(pa.string())),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    return scan


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    n: int = 13,
    slice_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """One row per document row: doc_id, text (bytes), n_words, hits (runs of hit words, end exclusive) and items.

    items: the ids, as strings, of items with an occurring window, in the order of strings, and last a null if one has no id. carry: the document's own
    columns ride along as the struct `row`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    small = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    measured = small.agg(F.sum(F.octet_length("text") + 64).alias("bytes")).first()["bytes"] or 0
    slices = max(1, math.ceil(measured / slice_bytes))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
        *own,
    )
    for k in range(slices):
        part = small if slices == 1 else small.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = part.collect()  # about slice_bytes
        listed = [(r["item_id"], (r["text"] or "").encode()) for r in rows]
        found = map_batches(found, scanner(spark.sparkContext.broadcast(WindowIndex(listed, n))), found.schema)
    return found


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_hits(text: bytes | None, hits: list) -> str | None:
    """The text without its hit runs; what separates words before and after a run stays."""
    if text is None:
        return None
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(TO_WORDS))] if hits else []
    out, done = [], 0
    for run in hits:
        out.append(text[done : spans[run["start"]][0]])
        done = spans[run["end"] - 1][1]
    return b"".join([*out, text[done:]]).decode()


def longest_run() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda most, x: F.greatest(most, x["end"] - x["start"]))


def decontaminate(docs: DataFrame, items: DataFrame, action: str = "documents", least_run: int | None = None, text_col: str = "text", **options) -> DataFrame:
    """docs with their own columns. action "documents": those of which a twentieth or more is hit, or with a run of
    `least_run` hit words (None: no matter how long), are dropped, and the rest stay unchanged; "spans": every document
    stays and the hit words are taken out of its text.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action: {action}")
    found = find_overlaps(docs, items, text_col=text_col, carry=True, **options)
    if action == "documents":
        bad = contaminated(hit_words(), F.col("n_words"))
        if least_run is not None:
            bad = bad | (longest_run() >= least_run)
        return found.where(~bad).select("row.*")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_hits(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "clean"])

    out = map_batches(found.select("row", "text", "hits"), clean, found.select("row", F.lit(None).cast("string").alias("clean")).schema)
    return out.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
