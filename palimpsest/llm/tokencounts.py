"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once and whole: its fields (columns of text) one after another, with `separator` between them. Each
token has a span of bytes in that text. Sections are the lines of a field, each with its line feed (a field without text
has none). Tokens are joined to sections by their spans, and a token that crosses a boundary is allocated by an explicit
rule: "first" (default) gives it to the section that has its first byte, "last" to the one that has its last byte,
"most" to the one that has most of its bytes (of equals the first). Bytes of separators belong to the section before
them, or to the first one if there is none. So a document's sections always add up to its tokens.

Defined cases: null and empty fields have no sections; a document without any section gives no rows; a very long text is
encoded in parts that end where the tokenizer's pattern ends a piece anyway (before a single space between two
letters), so that its tokens are the same; of sections with equally many of a token's bytes the first gets it; repeated
rows each give their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, map_batches

RULES = ("first", "last", "most")
PART = 1 << 20
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Encoder:
    """Byte-level BPE from a file of ranks; spans[i] is the number of bytes of token i."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spans = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.spans[rank] = len(token)

    def token_ends(self, text: str) -> np.ndarray:
        """Byte offset after each token of the text."""
        sizes, start = [], 0
        while start < len(text):
            end = len(text)
            if end - start > PART:
                cut_at = SAFE_CUT.search(text, start + PART)
                end = cut_at.start() if cut_at else end
            sizes.append(self.spans[np.array(self.encoding.encode_ordinary(text[start:end]), dtype=np.int64)])
            start = end
        return np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0, dtype=np.int64)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. bounds: byte offset after each section."""
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    owner = {"first": first, "last": last}.get(rule)
    if owner is None:
        owner = first.copy()
        for k in np.flatnonzero(first != last):
            edges = np.clip(np.concatenate(([starts[k]], bounds[first[k] : last[k] + 1])), starts[k], ends[k])
            owner[k] = first[k] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(bounds)), np.bincount(owner[first != last], minlength=len(bounds))


def sections(fields: list[tuple[str, str | None]], separator: str) -> tuple[str, list[tuple[str, int, int, int]], list[int]]:
    """The whole text; field, number in it, start and end (code points of the field) of each section; and the byte offset
    after each section.
    """
    present = [(name, value) for name, value in fields if value]
    found, bounds, at = [], [], 0
    for k, (name, value) in enumerate(present):
        start = 0
        for number, line in enumerate(value.split("\n")):
            end = min(start + len(line) + 1, len(value))
            if end > start:
                at += len(value[start:end].encode())
                found.append((name, number, start, end))
                bounds.append(at)
            start = end
        if k + 1 < len(present):
            at += len(separator.encode())
            bounds[-1] = at
    return separator.join(v for _, v in present), found, bounds


def count_tokens(docs: DataFrame, ranks: str, pattern: str, fields: tuple[str, ...] = ("text",), rule: str = "first", separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """A row for each section: doc_id, field, section, start, end, n_tokens and n_crossing (of these, over a boundary).

    ranks: path of the tokenizer's file of ranks, readable on every executor; pattern: its splitting pattern.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).token_ends
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                rows, found, tokens, crossing = [], [], [], []
                values = [batch.column(f"f{k}").to_pylist() for k in range(len(fields))]
                for k, of_row in enumerate(zip(*values, strict=True)):
                    text, of_doc, bounds = sections(list(zip(fields, of_row, strict=True)), separator)
                    if of_doc:
                        n, over = allocate(encode(text), np.array(bounds), rule)
                        rows += [k] * len(of_doc)
                        found += of_doc
                        tokens.append(n)
                        crossing.append(over)
                none = np.zeros(0, dtype=np.int64)
                names, numbers, starts, ends = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(names, pa.string()),
                        *(pa.array(c, pa.int64()) for c in (numbers, starts, ends)),
                        *(pa.array(np.concatenate([none, *c]), pa.int64()) for c in (tokens, crossing)),
                    ],
                    names=["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"f{k}") for k, c in enumerate(fields)])
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, count, f"doc_id {kind}, field string, section long, start long, end long, n_tokens long, n_crossing long")
