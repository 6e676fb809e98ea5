"""Language identification: known words first, then progressively shorter character n-grams.

Words are runs of letters, lower-cased. A word of the model adds its log frequency in each language; any other word adds
the mean log frequency of those of its n-grams (with `<` and `>` around the word) that the model knows, of the largest n
from `LONGEST` down to 1 that has any. A text's language is the one with the largest sum, and its score that language's
posterior probability.

The classifier is fitted on a bounded sample of labelled rows: about `sample_rows` rows of each language, chosen by a
hash of the id (all, where there are fewer), the `max_words` most frequent words and `max_grams` most frequent n-grams (None:
all). Everything is predicted, every n-gram of every word. Runs of over `LONGEST_WORD` letters are learned in pieces that
overlap by `LONGEST` - 1 letters, so that no n-gram of theirs is lost.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything if no language was learned;
a text of which no word has a known n-gram gets the most frequent language with the languages' even share as score;
equal sums go to the first language in the order of strings, and of equally frequent words the first are learned; repeated
rows get their own results; very long texts are read in parts cut at white space, runs of letters of any length in
blocks; an empty table gives no rows, and no language is learned from one; other columns are ignored by identify() and
kept by keep_identified().
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, cut, map_batches, split_at_space

WORD = re.compile(r"[^\W\d_]+")
LONGEST, LONGEST_WORD, REMEMBERED, REMEMBERED_NUMBERS, BLOCK = 5, 64, 50_000, 4_000_000, 1 << 16
UNKNOWN = "und"


def words(text: bytes) -> Iterator[list[str]]:
    for part in split_at_space(text):
        yield WORD.findall(part.decode().lower())


def grams(word: str, n: int) -> Iterator[list[str]]:
    """All n-grams of the word with its marks, in blocks."""
    marked = f"<{word}>"
    for start in range(0, len(marked) - n + 1, BLOCK):
        yield [marked[k : k + n] for k in range(start, min(start + BLOCK, len(marked) - n + 1))]


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces of it if it is very long."""
    if len(word) <= LONGEST_WORD:
        return [word]
    step = LONGEST_WORD - LONGEST + 1
    return [word[k : k + LONGEST_WORD] for k in range(0, len(word) - LONGEST + 1, step)]


class Model:
    """Log frequencies by language. rows and gram_rows give a word's and an n-gram's row in their matrices."""

    def __init__(self, counts: list[tuple[str, str, int]], max_grams: int | None = 100_000, smoothing: float = 0.5):
        """counts: words, languages and how often one occurs in the other."""
        self.languages = sorted({lang for _, lang, _ in counts})
        place = {lang: k for k, lang in enumerate(self.languages)}
        self.rows: dict[str, int] = {}
        for word, _, _ in counts:
            self.rows.setdefault(word, len(self.rows))
        table = np.zeros((len(self.rows), len(self.languages)))
        for word, lang, n in counts:
            table[self.rows[word], place[lang]] += n
        self.total = table.sum(axis=0)
        self.vectors = self._logs(table, self.total, smoothing)
        numbers: dict[str, int] = {}
        of_gram, of_word = array("i"), array("i")
        for word, k in self.rows.items():
            for n in range(1, LONGEST + 1):
                for found in grams(word, n):
                    of_gram.extend(numbers.setdefault(g, len(numbers)) for g in found)
                    of_word.extend([k] * len(found))
        gram_ids, word_ids = np.frombuffer(of_gram, dtype=np.int32), np.frombuffer(of_word, dtype=np.int32)
        weight = np.log1p(table)  # a frequent word's n-grams count more, but not in proportion
        by_gram = np.zeros((len(numbers), len(self.languages)))
        for k in range(len(self.languages)):
            by_gram[:, k] = np.bincount(gram_ids, weights=weight[:, k][word_ids], minlength=len(numbers))
        listed = list(numbers)
        kept = np.argsort(-by_gram.sum(axis=1), kind="stable")[:max_grams]
        sizes = np.array([len(listed[k]) for k in kept], dtype=np.int64)
        self.gram_rows = {listed[k]: i for i, k in enumerate(kept)}
        gram_table = by_gram[kept]
        self.gram_vectors = np.zeros(gram_table.shape, dtype=np.float32)
        for n in range(1, LONGEST + 1):
            if (sizes == n).any():
                self.gram_vectors[sizes == n] = self._logs(gram_table[sizes == n], gram_table[sizes == n].sum(axis=0), smoothing)

    @staticmethod
    def _logs(table: np.ndarray, total: np.ndarray, smoothing: float) -> np.ndarray:
        return np.log((table + smoothing) / (total + smoothing * (len(table) + 1))).astype(np.float32)

    def backoff(self, word: str) -> np.ndarray | None:
        for n in range(LONGEST, 0, -1):
            total, many = 0.0, 0
            for found in grams(word, n):
                known = [self.gram_rows[g] for g in found if g in self.gram_rows]
                if known:
                    total = total + self.gram_vectors[known].sum(axis=0)
                    many += len(known)
            if many:
                return total / many
        return None


class Scorer(dict):
    """From a word to its row; rows of words outside the model are made when first met and forgotten when too many."""

    def __init__(self, model: Model, remembered: int = REMEMBERED):
        super().__init__(model.rows)
        remembered = max(1000, min(remembered, REMEMBERED_NUMBERS // max(1, len(model.languages))))
        self.model, self.base, self.remembered = model, len(model.rows), remembered
        self.vectors = np.zeros((self.base + remembered + 1, len(model.languages)), dtype=np.float32)
        self.vectors[: self.base] = model.vectors
        self.nothing = self.base + remembered
        self.used = self.base

    def __missing__(self, word: str) -> int:
        vector = self.model.backoff(word)
        if vector is None:
            return self.nothing
        row = self.used
        self.vectors[row] = vector
        if len(word) <= LONGEST_WORD:
            self[word] = row
        self.used += 1
        return row

    def predict(self, text: bytes | None) -> tuple[str, float]:
        model, total, letters, found = self.model, 0.0, False, False
        for part in words(text or b""):
            letters = letters or bool(part)
            for k in range(0, len(part), self.remembered):
                some = part[k : k + self.remembered]
                if self.used + len(some) > self.base + self.remembered:
                    self.clear()
                    self.update(model.rows)
                    self.used = self.base
                rows = np.fromiter(map(self.__getitem__, some), dtype=np.int64, count=len(some))
                found = found or bool((rows != self.nothing).any())
                total = total + self.vectors[rows].sum(axis=0, dtype=np.float64)
        if not letters or not model.languages:
            return UNKNOWN, 0.0
        if not found:
            return model.languages[int(model.total.argmax())], 1.0 / len(model.languages)
        best = int(np.argmax(total))
        return model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, sample_rows: int = 3000, max_words: int | None = 100_000, max_grams: int | None = 100_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled rows of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = rows.groupBy("lang").count()
    # A language's share of rows is kept by the hash of their ids. One row for each language, as in the model itself.
    shares = per_lang.select("lang", F.least(F.lit(1.0), sample_rows / F.col("count")).alias("share"))
    if rows.isEmpty():
        return Model([], max_grams)
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def given() -> pa.RecordBatch:
            langs, texts = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for part in words(text):
                    found.update((lang, piece) for w in part for piece in pieces(w))
                if len(found) > 200_000:
                    yield given()
                    found.clear()
        yield given()

    counts = map_batches(sample.select("text", "lang"), count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    top = counts.groupBy("word").agg(F.sum("n").alias("total"))
    if max_words is not None:
        top = F.broadcast(top.orderBy(F.desc("total"), "word").limit(max_words))
    kept = counts.join(top, "word").orderBy(F.desc("total"), "word", "lang").select("word", "lang", "n").toArrow()  # words of the sample only
    return Model(list(zip(*(kept.column(c).to_pylist() for c in ("word", "lang", "n")), strict=True)), max_grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of each row; carry: and the row itself as the struct `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(x) for x in batch.column("text").to_pylist()]
            made = {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}
            kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(kept | made)

    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    source = docs.select(F.col(id_col).alias("doc_id"), *own, F.col(text_col).cast("binary").alias("text"))
    schema = source.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return map_batches(source, predict, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, **options) -> DataFrame:
    """docs without those that have no letter or whose language's posterior stays below min_score."""
    found = identify(docs, model, carry=True, **options)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
