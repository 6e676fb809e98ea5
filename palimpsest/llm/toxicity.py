"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with `<` and `>` around it) and of itself, each hashed to one of
`buckets` vectors; its vector is their mean, a text's vector the mean of its words' and of `EMPTY` zeros, and a linear softmax of that gives
the probability of each class. An unseen misspelling so shares vectors with the words whose n-grams it has. Vectors and
softmax are trained together by full-batch Adam on the cross-entropy.

The classifier is fitted on a bounded sample of labelled rows: about `sample_rows` rows of each label, chosen by a hash
of the id, of at most `sample_bytes` bytes each and weighted back to the labels' true shares, and the `max_words` words
that most of them have. Everything is scored, whole.

Every n-gram of every word counts, in training and scoring, however long the word is.

Defined cases: null texts and texts without words get the softmax's bias, the share of toxic texts that training found;
labels of null are ignored, the larger label counts where an id is labelled twice; without labelled rows the score is 0;
repeated rows get their own results; of words that equally many texts have those met first in training are kept; very long
texts are read in parts cut at white space, and very long words in blocks; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, map_batches, split_at_space

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST, LONGEST_REMEMBERED, REMEMBERED, BLOCK = 3, 5, 64, 150_000, 1 << 16
EMPTY = 20  # words of vector 0 that each text has besides, so that a few odd words don't decide on a short one


def words(text: bytes) -> Iterator[list[str]]:
    for part in split_at_space(text):
        yield WORD.findall(part.decode().lower())


def subwords(word: str, buckets: int) -> Iterator[int]:
    """Buckets of the word itself and of its n-grams."""
    marked = f"<{word}>"
    yield zlib.crc32(marked.encode()) % buckets
    for n in range(SHORTEST, LONGEST + 1):
        for k in range(len(marked) - n + 1):
            yield zlib.crc32(marked[k : k + n].encode()) % buckets


class Rows:
    """A sparse matrix by rows, with its transpose, for products with dense matrices."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.by_row = self._sorted(row, column, value)
        self.by_column = self._sorted(column, row, value)

    @staticmethod
    def _sorted(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(row, kind="stable")
        present, starts = np.unique(row[order], return_index=True)
        return present, starts, column[order].astype(np.int32), value[order].astype(np.float32)

    @staticmethod
    def _product(parts: tuple[np.ndarray, ...], dense: np.ndarray, rows: int) -> np.ndarray:
        present, starts, column, value = parts
        out = np.zeros((rows, dense.shape[1]), dtype=np.float32)
        for k in range(dense.shape[1] if len(present) else 0):  # a column at a time needs little memory
            out[present, k] = np.add.reduceat(dense[:, k][column] * value, starts)
        return out

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self._product(self.by_row, dense, self.shape[0])

    def transposed_dot(self, dense: np.ndarray) -> np.ndarray:
        return self._product(self.by_column, dense, self.shape[1])


class Model:
    """embeddings of the buckets, and the linear softmax over the classes 0 and 1."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.embeddings, self.weights, self.bias = embeddings, weights, bias
        self.slopes = (embeddings @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
        self.offset = float(bias[1] - bias[0])

    def word_logit(self, word: str) -> float:
        """The share of a word's vector in the log odds; linear, so a text's log odds are a mean of its words'."""
        total, n, each = 0.0, 0, subwords(word, len(self.slopes))
        while some := list(itertools.islice(each, BLOCK)):
            total += float(self.slopes[some].sum(dtype=np.float64))
            n += len(some)
        return total / n


class Bags:
    """Texts as counts of numbered words, in arrays."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.counts, self.sizes, self.totals = array("i"), array("i"), array("i"), array("q")

    def add(self, text: bytes) -> None:
        found = Counter(w for part in words(text) for w in part)
        self.ids.extend(self.numbers.setdefault(w, len(self.numbers)) for w in found)
        self.counts.extend(found.values())
        self.sizes.append(len(found))
        self.totals.append(sum(found.values()))

    def most_common(self, n: int) -> tuple[list[str], Rows]:
        """The n words of most texts, and for each text their shares in it."""
        ids, counts = np.frombuffer(self.ids, dtype=np.int32), np.frombuffer(self.counts, dtype=np.int32)
        text = np.repeat(np.arange(len(self.sizes)), np.frombuffer(self.sizes, dtype=np.int32))
        listed = list(self.numbers)
        order = np.argsort(-np.bincount(ids, minlength=len(listed)), kind="stable")[:n]
        new = np.full(len(listed) + 1, -1)
        new[order] = np.arange(len(order))
        kept = new[ids] >= 0
        shares = counts / (np.frombuffer(self.totals, dtype=np.int64)[text] + EMPTY)
        return [listed[k] for k in order], Rows(text[kept], new[ids][kept], shares[kept], (len(self.sizes), len(order)))


def train(bags: Bags, labels: np.ndarray, weights: np.ndarray, buckets: int = 1 << 16, width: int = 8, steps: int = 150, rate: float = 1.0, max_words: int = 40_000, decay: float = 1e-5, seed: int = 7) -> Model:
    """weights: of each text in the loss."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    linear = rng.normal(0, 0.1, (width, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    common, text_rows = bags.most_common(max_words)
    ids = [list(subwords(w, buckets)) for w in common]
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    word_rows = Rows(np.repeat(np.arange(len(ids)), sizes), np.array([i for x in ids for i in x], dtype=np.int64), np.repeat(1 / np.maximum(sizes, 1), sizes), (len(ids), buckets))
    del ids
    target = np.stack([1 - labels, labels], axis=1).astype(np.float32)
    weights = (weights / weights.sum()).astype(np.float32)[:, None]
    parameters = [embeddings, linear, bias]
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        text_vectors = text_rows.dot(word_rows.dot(embeddings))
        logits = text_vectors @ linear + bias
        logits -= logits.max(axis=1, keepdims=True)
        probabilities = np.exp(logits)
        probabilities /= probabilities.sum(axis=1, keepdims=True)
        error = (probabilities - target) * weights
        gradients = [word_rows.transposed_dot(text_rows.transposed_dot(error @ linear.T)) + decay * embeddings / len(labels), text_vectors.T @ error, error.sum(axis=0)]
        for p, g, m, s in zip(parameters, gradients, means, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(embeddings, linear, bias)


class Scorer(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        out = self.model.word_logit(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = out
        return out

    def score(self, text: bytes | None) -> float:
        total, n = 0.0, 0
        for part in words(text or b""):
            total += sum(map(self.__getitem__, part))
            n += len(part)
        return float(1 / (1 + np.exp(-np.clip(self.model.offset + total / (n + EMPTY), -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_bytes: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model | None:
    """A model of the labelled rows of docs; None if there are none."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    of_each = {r["label"]: r["count"] for r in marked.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in of_each.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    # About 2 * sample_rows ids, so that they can be sent to all executors.
    chosen = marked.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= sample_bytes)
    sample = rows.join(F.broadcast(chosen), "id").select("text", "label").orderBy("label", F.xxhash64("text"), "text")
    bags, found = Bags(), []
    for r in sample.toLocalIterator():
        bags.add(r["text"].encode())
        found.append(r["label"])
    if not found:
        return None
    counts = Counter(found)
    weights = np.array([of_each[k] / counts[k] for k in found], dtype=np.float64)
    return train(bags, np.array(found), weights, **options)


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * width numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return map_batches(source, score, source.select("doc_id", F.lit(0.0).alias("score")).schema)
