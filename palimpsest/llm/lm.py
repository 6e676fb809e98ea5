"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are a text's words (what ASCII white space separates, A-Z as a-z) and one end. The model's outputs are the end, the
most frequent words, as many as the square root of the training tokens but `shortlist` at most, and `tails` classes that
share out all other words by their last letters. The previous `CONTEXT` outputs each have a vector for their place, and
the sum of these is the predicted vector. Outputs, ordered by frequency, fall into about as many groups as the square root
of their number. The predicted vector's products with the groups' vectors, plus biases, are normalised over all groups,
and those with the vectors of a group's outputs over the group: batched matrix products give log-probabilities, normalised
over all outputs. A word of a class has, within it, the share (c + 1/2) / (N + (V + 1) / 2) of the class's counts, which
leaves a half count for unseen words, so that the probabilities of all words add up to one.

Word counts are exact, over all training documents: they are summed by Spark, the `head` most frequent words (so a
bounded table) are broadcast, and other words are looked up by a join. Parameters are trained on every position of every
training document, once. The documents are dealt by a hash of id and text into shards of about SHARD positions, so that
no task holds more, and of which the number follows the corpus. Each of the `rounds` rounds takes the positions that the
others leave; in a round each shard is trained from the shared parameters in an order of its own, and the mean of the
shards' parameters, weighted by positions, begins the next round. So neither partitions nor retried tasks change the model
(but for the rounding of sums).

Defined cases: null and empty texts are the end alone; unseen words count as c = 0; without training documents all
outputs are equally likely; of equally frequent words those first by their bytes come into the shortlist and the head;
repeated rows are learned from and scored each; a very long text is read, learned and scored in parts; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, cut, map_batches, split_at_space

CONTEXT, NOISE, OWN_NOISE, ROWS = 4, 24, 8, 1 << 15
SMALLEST, LARGEST = 256, 1 << 14  # positions of a batch in training
SHARD, PART = 1 << 22, 1 << 16  # positions of a shard, and of a document's parts that are dealt out
AFTER_WORD = b".,;:!?%&$#*|\"')"
FLUSH = 400_000


def words(text: bytes | None) -> Iterator[list[bytes]]:
    for part in split_at_space((text or b"").lower()):
        yield part.split()


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32((word.rstrip(AFTER_WORD) or word)[-2:]) % tails


@dataclass
class Vocabulary:
    """ids: of head words; output, within and base: by id, the output and the log10 shares within it and by base.

    Outputs stand by their counts. end and tails: the outputs of the end and of the classes. class_scale and base_scale:
    what a count is divided by.
    """

    ids: dict[bytes, int]
    output: np.ndarray
    within: np.ndarray
    base: np.ndarray
    end: int
    tails: np.ndarray
    train_tokens: int
    ends: int
    output_counts: np.ndarray
    class_scale: np.ndarray
    base_scale: float

    @property
    def outputs(self) -> int:
        return len(self.output_counts)

    def outputs_of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: not in the head) and output of each word."""
        ids = np.fromiter(map(self.ids.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        out = self.output[ids]
        for k in np.flatnonzero(ids < 0):
            out[k] = self.tails[tail_class(found[k], len(self.tails))]
        return ids, out


def count_words(docs: DataFrame, text_col: str, tails: int) -> DataFrame:
    """word, its class and its count in docs. Words are bytes, so any text counts as it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def given() -> pa.RecordBatch:
            classes = [tail_class(w, tails) for w in found]
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(classes, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for part in words(text):
                    found.update(part)
                if len(found) > FLUSH:
                    yield given()
                    found.clear()
        yield given()

    source = docs.select(F.col(text_col).cast("binary").alias("text"))
    return map_batches(source, count, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int, head: int, shortlist: int, tails: int) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()  # a bounded table
    listed, of, n = top.column("word").to_pylist(), top.column("class").to_numpy(), top.column("n").to_numpy()
    class_n, class_v = np.zeros(tails), np.zeros(tails)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    train_tokens, distinct = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    shortlist = min(shortlist, max(255, math.isqrt(train_tokens)), len(listed))
    np.subtract.at(class_n, of[:shortlist], n[:shortlist])
    np.subtract.at(class_v, of[:shortlist], 1)
    class_scale = class_n + 0.5 * (class_v + 1)
    base_scale = train_tokens + 0.5 * (distinct + 1)
    output_counts = np.concatenate([[ends], n[:shortlist], class_n])  # the end, the words, the classes
    by_count = np.argsort(-output_counts, kind="stable")
    place = np.empty(len(by_count), dtype=np.int64)
    place[by_count] = np.arange(len(by_count))
    output = place[np.concatenate([1 + np.arange(shortlist), 1 + shortlist + of[shortlist:], [0]]).astype(np.int64)]
    within = np.concatenate([np.zeros(shortlist), np.log10((n[shortlist:] + 0.5) / class_scale[of[shortlist:]]), [0]])
    base = np.concatenate([np.log10((n + 0.5) / base_scale), [0]])
    return Vocabulary({w: k for k, w in enumerate(listed)}, output, within, base, int(place[0]), place[1 + shortlist :], train_tokens, ends, output_counts[by_count], class_scale, base_scale)


def group_starts(output_counts: np.ndarray) -> np.ndarray:
    """The first output of each group: groups have even shares of the square roots of counts, so that frequent outputs
    stand in small ones."""
    mass = np.sqrt(output_counts + 0.5)
    middle = (np.cumsum(mass) - mass / 2) / mass.sum()
    return np.unique((middle * round(math.sqrt(len(mass)))).astype(np.int64), return_index=True)[1]


class Model:
    """contexts[j]: vectors of outputs (and of the start, the last) j + 1 places before; groups, group_bias: of groups of
    outputs; targets, bias: of outputs within their group."""

    NAMES = ("contexts", "groups", "group_bias", "targets", "bias")

    def __init__(self, output_counts: np.ndarray, *parameters: np.ndarray):
        self.contexts, self.groups, self.group_bias, self.targets, self.bias = parameters
        share = (output_counts + 0.5) / (output_counts + 0.5).sum()
        self.output_counts, self.starts = output_counts, group_starts(output_counts)
        self.stops = np.append(self.starts[1:], len(share))
        self.group = np.repeat(np.arange(len(self.starts)), self.stops - self.starts)
        self.group_share = np.add.reduceat(share, self.starts)
        self.own_share = share / self.group_share[self.group]
        self.reached = np.cumsum(share)

    @classmethod
    def fresh(cls, output_counts: np.ndarray, width: int, seed: int = 3) -> Model:
        rng, k = np.random.default_rng(seed), len(output_counts)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        groups = len(group_starts(output_counts))
        out = cls(output_counts, draw(CONTEXT, k + 1, width), draw(groups, width), np.zeros(groups, np.float32), draw(k, width), np.zeros(k, np.float32))
        out.group_bias += np.log(out.group_share).astype(np.float32)
        out.bias += np.log(out.own_share).astype(np.float32)
        return out

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def filled(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in self.parameters():
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(self.output_counts, *parts)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """before: for each position, the outputs 1 to CONTEXT places before it."""
        out = self.contexts[0][before[:, 0]]
        for j in range(1, CONTEXT):
            out += self.contexts[j][before[:, j]]
        return out

    def log_probabilities(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all outputs: of the target's group, and of the target within it."""
        out = np.empty(len(target), dtype=np.float64)
        for at in range(0, len(target), ROWS):
            q, t = self.predicted(before[at : at + ROWS]), target[at : at + ROWS]
            of = self.group[t]
            found = log_share(q, self.groups, self.group_bias, of)
            order = np.argsort(of.astype(np.uint16), kind="stable")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                start, stop = self.starts[of[rows[0]]], self.stops[of[rows[0]]]
                if stop - start > 1:
                    found[rows] += log_share(q[rows], self.targets[start:stop], self.bias[start:stop], t[rows] - start)
            out[at : at + ROWS] = found
        return out

    def train(self, before: np.ndarray, target: np.ndarray, rate: float, seed: int) -> Model:
        """One pass of noise-contrastive estimation with Adagrad over rows of contexts and targets, in batches as they stand.
        The noise is the groups' frequency, and for the targets of a group the frequency of its outputs; a batch shares it."""
        rng = np.random.default_rng(seed)
        model = Model(self.output_counts, *(p.copy() for p in self.parameters()))
        squares = [np.full_like(p, 1e-6) for p in model.parameters()]
        log_groups = np.log(NOISE * self.group_share).astype(np.float32)
        log_own = np.log(OWN_NOISE * self.own_share).astype(np.float32)
        low, chance = np.concatenate([[0], self.reached])[self.starts], self.group_share / self.group_share.sum()
        batch = min(LARGEST, max(SMALLEST, len(target) // 120))
        for at in range(0, len(target), batch):
            # By target, so that targets of a group, and equal ones, stand together.
            order = np.argsort(target[at : at + batch], kind="stable")
            b, t = before[at : at + batch][order], target[at : at + batch][order]
            q, of = model.predicted(b), self.group[t]
            scale = np.float32(1 / len(t))
            # Groups.
            drawn = rng.choice(len(chance), NOISE, p=chance)
            up = (sigmoid((q * model.groups[of]).sum(axis=1) + model.group_bias[of] - log_groups[of]) - 1)[:, None]
            down = sigmoid(q @ model.groups[drawn].T + (model.group_bias[drawn] - log_groups[drawn]))
            by_q = up * model.groups[of] + down @ model.groups[drawn]
            rows = np.concatenate([of, drawn])
            step(model.groups, squares[1], *summed(rows, np.concatenate([up * q, down.T @ q]) * scale), rate)
            step(model.group_bias, squares[2], *summed(rows, np.concatenate([up[:, 0], down.sum(axis=0)]) * scale), rate)
            # Outputs within their groups.
            own = sigmoid((q * model.targets[t]).sum(axis=1) + model.bias[t] - log_own[t]) - 1
            own[self.stops[of] - self.starts[of] == 1] = 0
            by_q += own[:, None] * model.targets[t]
            edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            noise_rows, noise_sums, noise_errors = [], [], []
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                g = of[first]
                if self.stops[g] - self.starts[g] == 1:
                    continue
                noise = np.searchsorted(self.reached, low[g] + rng.random(OWN_NOISE) * self.group_share[g], side="right").clip(self.starts[g], self.stops[g] - 1)
                vectors, mine = model.targets[noise], q[first:last]
                error = sigmoid(mine @ vectors.T + (model.bias[noise] - log_own[noise]))
                by_q[first:last] += error @ vectors
                noise_rows.append(noise)
                noise_sums.append(error.T @ mine)
                noise_errors.append(error.sum(axis=0))
            for j in range(CONTEXT):
                step(model.contexts[j], squares[0][j], *summed(b[:, j], by_q * scale), rate)
            rows = np.concatenate([t, *noise_rows])
            step(model.targets, squares[3], *summed(rows, np.concatenate([own[:, None] * q, *noise_sums]) * scale), rate)
            step(model.bias, squares[4], *summed(rows, np.concatenate([own, *noise_errors]) * scale), rate)
        return model


def log_share(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The logarithm of each row's own share in the exponentials of its products with all vectors, plus biases."""
    logits = q @ vectors.T
    logits += bias
    picked = logits[np.arange(len(logits)), own].astype(np.float64)
    most = 0.0
    if len(logits) and max(logits.max(), -logits.min()) > 60:  # else their exponentials can be added up as they are
        most = logits.max(axis=1)
        logits -= most[:, None]
    np.exp(logits, out=logits)
    return picked - most - np.log(logits.sum(axis=1, dtype=np.float64))


def step(parameters: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Adagrad, of the given rows only."""
    squares[rows] += gradient * gradient
    parameters[rows] -= rate * gradient / np.sqrt(squares[rows])


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that occur, and their values added up."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
    if not len(first):
        return rows[:0], values[:0]
    return sorted_rows[first], np.add.reduceat(values[order], first, axis=0)


def sigmoid(scores: np.ndarray) -> np.ndarray:
    """In place: only few passes over the many noise scores."""
    np.clip(scores, -30, 30, out=scores)
    np.negative(scores, out=scores)
    np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


def contexts_of(outputs: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT outputs before each position."""
    padded = np.concatenate([np.full(CONTEXT, start, dtype=outputs.dtype), outputs])
    return np.stack([padded[CONTEXT - 1 - j : len(padded) - 1 - j] for j in range(CONTEXT)], axis=1)


def training_shards(docs: DataFrame, shared, shards: int, id_col: str, text_col: str) -> DataFrame:
    """shard, and as 16-bit numbers the outputs of its documents, each document's (and each part's of a long one) after
    CONTEXT starts or what stood before it. Within a shard they stand in an order that only depends on themselves."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        starts = np.full(CONTEXT, v.outputs, dtype="<u2")
        for batch in batches:
            keys, packed = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = np.concatenate([*(v.outputs_of(part)[1].astype("<u2") for part in words(text)), np.array([v.end], dtype="<u2")])
                for at in range(0, len(whole), PART):
                    # What stands before a later part is marked, by the highest bit, as context only.
                    before = whole[at - CONTEXT : at] | np.uint16(1 << 15) if at else starts
                    packed.append(np.concatenate([before, whole[at : at + PART]]).tobytes())
                    keys.append(zlib.crc32(b"%d:%d" % (key, at)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "outputs"])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("key").to_pylist(), table.column("outputs").to_pylist(), strict=True))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "outputs": pa.array([b"".join(x for _, x in rows)], pa.binary())})

    source = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    parts = map_batches(source, take, "key long, outputs binary").withColumn("shard", F.col("key") % shards)
    return parts.repartition(shards, "shard").groupBy("shard").applyInArrow(gather, "shard long, outputs binary")


def positions_of(stream: np.ndarray, start: int, turn: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """A round's positions in a stream: the outputs before each and its own. Each position is in exactly one round."""
    context_only = np.uint16(1 << 15)
    at = np.flatnonzero((stream != start) & (stream < context_only))[turn::rounds]
    plain = stream & ~context_only
    return plain[at[:, None] - np.arange(1, CONTEXT + 1)], plain[at]


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of seen and of the arrays total."""
    seen, total = 0, None
    for batch in batches:
        for n, packed in zip(batch.column("seen").to_pylist(), batch.column("total").to_pylist(), strict=True):
            mine = np.frombuffer(packed)
            seen, total = seen + n, mine if total is None else total + mine
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "total"])


def mean_of_shards(model: Model, shards: DataFrame, n_shards: int, rate: float, turn: int = 0, rounds: int = 1) -> Model:
    """One round: each shard trains from the model; the mean of their parameters, weighted by positions. Sums are made
    in three steps, so that no task adds up more than some hundred arrays for each thousand shards."""
    shared = shards.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the shortlist

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = shared.value
        for batch in batches:
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("outputs").to_pylist(), strict=True):
                before, target = positions_of(np.frombuffer(packed, dtype="<u2"), len(begun.output_counts), turn, rounds)
                if len(target):
                    now = begun.train(before, target, rate, shard)
                    total = (now.flat().astype(np.float64) * len(target)).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([len(target)], pa.int64()), pa.array([total], pa.binary())], names=["seen", "total"])

    kind = "seen long, total binary"
    by_task = map_batches(shards, lambda batches: added(train(batches)), kind)
    sums = map_batches(by_task.repartition(max(1, math.isqrt(n_shards))), added, kind)
    found = map_batches(sums.coalesce(1), added, kind).collect()  # one row
    return model.filled(np.frombuffer(found[0]["total"]) / found[0]["seen"]) if found else model


def score(docs: DataFrame, training: DataFrame, shortlist: int = 4095, tails: int = 64, width: int = 8, head: int = 1 << 17, rounds: int = 3, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10), and what keep adds.

    training: the documents to learn from.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = cut(count_words(training, text_col, tails))
    v = vocabulary(counts, training.count(), head, shortlist, tails)
    shared = spark.sparkContext.broadcast(v)
    n_shards = max(1, -(-v.train_tokens // SHARD))
    shards = cut(training_shards(training, shared, n_shards, id_col, text_col))
    model = Model.fresh(v.output_counts, width)
    for turn in range(rounds):
        model = mean_of_shards(model, shards, n_shards, rate / (1 + turn), turn, rounds)
    with_model = spark.sparkContext.broadcast((v, model))
    known_end, base_end = int(v.ends > 0), math.log10((v.ends + 0.5) / v.base_scale)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = with_model.value
        unknown = pa.struct([("word", pa.binary()), ("class", pa.int32()), ("times", pa.int64())])
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                n, known, base, total = (np.zeros(batch.num_rows) for _ in range(4))
                rest, pending, waiting = [], [], 0

                def settle(pending: list, total: np.ndarray) -> None:
                    if pending:
                        of, befores, targets = (np.concatenate(x) for x in zip(*pending, strict=True))
                        total += np.bincount(of, model.log_probabilities(befores, targets), len(total)) / math.log(10)
                        pending.clear()

                for d, text in enumerate(batch.column("text").to_pylist()):
                    tail = np.zeros(0, dtype=np.int64)
                    missing: Counter = Counter()
                    last = None
                    for part in itertools.chain(words(text), [None]):
                        if last is not None:
                            ids, outputs = v.outputs_of(last)
                            if part is None:
                                outputs = np.append(outputs, v.end)
                            rows = contexts_of(np.concatenate([tail, outputs]), v.outputs)[len(tail) :]
                            pending.append((np.full(len(outputs), d), rows, outputs))
                            waiting += len(outputs)
                            if waiting > ROWS:
                                settle(pending, total)
                                waiting = 0
                            inside = ids[ids >= 0]
                            total[d] += v.within[inside].sum()
                            base[d] += v.base[inside].sum()
                            known[d] += len(inside)
                            n[d] += len(outputs)
                            missing.update(last[i] for i in np.flatnonzero(ids < 0))
                            tail = np.concatenate([tail, outputs])[-CONTEXT:]
                        last = part
                    rest.append([{"word": w, "class": tail_class(w, len(v.tails)), "times": t} for w, t in missing.items()])
                settle(pending, total)
                made = {"n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64) + known_end), "base_score": pa.array(base + base_end), "score": pa.array(total)}
                kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(kept | made | {"rest": pa.array(rest, pa.list_(unknown))})

    source = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("binary").alias("text"))
    schema = source.drop("text").withColumns({"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0), "rest": F.array().cast("array<struct<word:binary,class:int,times:long>>")}).schema
    scanned = cut(map_batches(source, scan, schema).withColumn("__row", F.monotonically_increasing_id()))
    each = scanned.select("__row", F.explode("rest").alias("x")).select("__row", "x.word", "x.class", "x.times")
    found = each.join(counts.select("word", "n"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)) + 0.5)
    # A class's scale, from the few dozen that the model has.
    scale = F.element_at(F.array(*[F.lit(float(x)) for x in v.class_scale]), F.col("class") + 1)
    added = found.groupBy("__row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("__known"),
        F.sum(F.col("times") * F.log10(F.col("c") / F.lit(float(v.base_scale)))).alias("__base"),
        F.sum(F.col("times") * F.log10(F.col("c") / scale)).alias("__score"),
    )
    nothing = F.lit(0)
    names = [c for c in source.columns if c != "text"]
    return scanned.join(added, "__row", "left").select(
        *names,
        "n_tokens",
        (F.col("n_known") + F.coalesce("__known", nothing)).alias("n_known"),
        F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("__base", nothing.cast("double"))).alias("base_score"),
        (F.col("score") + F.coalesce("__score", nothing.cast("double"))).alias("score"),
    )
