"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

A document's ids are those of its text followed by one end id. Only documents longer than a sequence are cut, into
pieces of a whole sequence and a rest. A piece of `capacity` ids fills a sequence by itself. The others are dealt by
hash into groups of about `group_rows`, and in each group every piece goes where the sum over gaps of the squared number
of open bins with that gap becomes smallest (a new bin counts as one more of its gap; of equal sums the fullest bin is taken).
The bins that a round leaves open are then items of the next round, in fewer groups, until one group holds them all or a
round leaves over 99 of 100 as they were. So no task holds more than a group, and the last rounds see only what is left
open.

Tokens: words repeat, and the tokenizer treats what ASCII white space separates by itself, so the ids of each such chunk
are remembered in a bounded table.

Defined cases: null and empty texts are the end id alone; a text of any length is read in parts; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, cut, map_batches, split_at_space

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
REMEMBERED, REMEMBERED_BYTES, LONGEST_REMEMBERED = 150_000, 16 << 20, 256


class ChunkEncoder(dict):
    """From a chunk without ASCII white space to its ids as little-endian unsigned 32-bit bytes.

    For chunks of Latin-1 characters the pieces are merged by a byte-pair encoder built from the same file, in which
    a word's end is the byte 0xFF (never part of UTF-8); everything else goes to the tokenizer itself.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.remembered, self.held = path, remembered, 0
        self.fast = byte_pair_encoder(path)

    @functools.cached_property
    def tokenizer(self):
        """Loaded when first needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.fast(chunk) if self.fast else None
        if out is None:
            out = np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= self.remembered or self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            self[chunk] = out
            self.held += len(chunk) + len(out)
        return out

    def ids(self, text: bytes) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, part.split())) for part in split_at_space(text)])


def byte_pair_encoder(path: str):
    """A function from a chunk to its ids' bytes, or to None where it isn't sure to agree with the tokenizer; None for
    other kinds of tokenizer than lower-casing byte-level BPE with word ends.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1:
        return None
    pattern = regex.compile(splits[0]["pattern"]["Regex"])
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {x["content"] for x in spec["added_tokens"]}
    ranks: dict[bytes, int] = {}
    for token, rank in model["vocab"].items():
        if token in special:
            continue
        ended = token.endswith(suffix)
        ranks[bytes(byte_of[c] for c in token.removesuffix(suffix)) + b"\xff" * ended] = rank
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    merge = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    coded = [i.to_bytes(4, "little") for i in range(max(ranks.values()) + 1)]

    class Pieces(dict):
        def __missing__(self, piece: str) -> bytes:
            out = b"".join([coded[i] for i in merge(piece.encode() + b"\xff")])
            if len(self) >= REMEMBERED // 2:
                self.clear()
            if len(piece) <= LONGEST_REMEMBERED // 4:
                self[piece] = out
            return out

    known = Pieces()

    def ids(chunk: bytes) -> bytes | None:
        text = chunk.decode().lower()
        if text.isalpha() and (chunk.isascii() or max(text) <= "\xff"):
            return known[text]
        if not chunk.isascii() and max(chunk.decode()) > "\xff" or "<|" in text:
            return None
        return b"".join([known[piece] for piece in pattern.findall(text)])

    return ids


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES of each document row. tokenizer: path of the tokenizer's file, readable on every executor."""
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        step = capacity * 4
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = ids_of(text or b"") + end
                for piece, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    for column, value in zip(columns, (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = as_bytes(docs, id_col, text_col)
    return map_batches(source, encode, PIECES.replace("doc_id long", f"doc_id {source.schema['doc_id'].dataType.simpleString()}"))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and what each bin holds. Lengths are from 1 to capacity."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by level
    counts = np.zeros(capacity + 1, dtype=np.int64)
    levels: list[int] = []
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    impossible = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        # Moving a bin from level h to h + size changes the sum by 2 * (N(h + size) - N(h)) + 2; full bins don't count.
        change = 2 * (counts[size:] - counts[: capacity + 1 - size]) + 2
        change[0] = 2 * counts[size] + 1
        if size < capacity:
            change[-1] = 1 - 2 * counts[capacity - size]
            change[1:][counts[1 : capacity + 1 - size] == 0] = impossible
        else:
            change[0] = 0
        best = change.min()
        level = int(np.flatnonzero(change == best)[-1])  # of equals the fullest
        if level:
            counts[level] -= 1
            slot = open_bins[level].pop()
        else:
            slot = len(levels)
            levels.append(0)
        bins[k], offsets[k] = slot, level
        levels[slot] = level + size
        if level + size < capacity:
            counts[level + size] += 1
            open_bins[level + size].append(slot)
    return bins, offsets, levels


def packer(capacity: int):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("item").to_numpy(), table.column("mix").to_numpy()))
        bins, offsets, levels = sum_of_squares(lengths[order], capacity)
        group = key[0].as_py()
        return pa.table(
            {
                "item": table.column("item").take(pa.array(order)),
                "bin": pa.array(bins * (1 << 24) + group, pa.int64()),
                "at": pa.array(offsets, pa.int64()),
                "level": pa.array(np.array(levels, dtype=np.int64)[bins], pa.int64()),
            }
        )

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, group_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its place: PIECES, sequence_id and offset."""
    pieces = cut(cut_into_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("item", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == capacity)
    whole = whole.withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    parts = pieces.where(F.col("length") < capacity)
    items = parts.select("item", "length")
    placed, n, turn = None, items.count(), 0
    while n:
        groups = -(-n // group_rows)
        mix = F.xxhash64("item", F.lit(turn))
        dealt = items.select("item", "length", mix.alias("mix"), F.pmod(mix, F.lit(groups)).alias("bucket"))
        done = cut(
            dealt.repartition(groups, "bucket").groupBy("bucket").applyInArrow(packer(capacity), "item long, bin long, at long, level long")
        )
        tag = F.col("bin") * 1024 + turn
        if placed is None:
            placed = done.select("item", tag.alias("sequence_id"), F.col("at").alias("offset"))
        else:
            later = done.select(F.col("item").alias("__held"), tag.alias("__bin"), F.col("at").alias("__at"))
            placed = placed.join(later, F.col("sequence_id") == F.col("__held"), "left").select(
                "item",
                F.coalesce("__bin", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("__at", F.lit(0))).alias("offset"),
            )
        left = done.where(F.col("level") < capacity).select(tag.alias("item"), F.col("level").alias("length")).distinct()
        before, n = n, left.count()
        turn += 1
        if groups == 1 or n > 0.99 * before or turn == 1024:
            break
        items = left
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if placed is None:
        return whole.select(*columns)
    return whole.select(*columns).unionByName(parts.join(placed, "item").select(*columns))
