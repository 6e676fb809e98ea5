"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document's set holds its distinct `size`-word shingles; two documents link when 100 * intersection >= percent * union.
Equal sets are one class from the start. The tokens (shingles) have one global order, rare ones by their hash and then
frequent ones by their count; any partner of a set with n tokens shares all but slack(n) of them, so:

* if the set has more than slack(n) rare tokens, its first slack(n) + 1 are indexed one by one;
* else all its rare tokens are indexed one by one, and its prefix is extended into the frequent tokens, which fall into
  groups by their hash: pairs of a group's tokens are indexed, triples if the tokens are very frequent. A group with c
  tokens counts as c - 1, or c - 2, until rare tokens and groups count slack(n) + 1. The number of groups depends on the
  set's size class; partners' size classes differ by one at most, so each set is indexed under its own class and the next.

Sets that link share an indexed token or combination: otherwise more than slack(n) of the shorter prefix would be
unshared. Which tokens are frequent only matters for speed. They are counted over all documents in bounded blocks,
adding up what repeats within a block. Lists of single tokens are then counted exactly: those of long lists become
frequent, too, leave the index, and the lists' members are indexed once more, with prefixes that go beyond these tokens.
At most MOST_FREQUENT are broadcast.

Posting lists keep only members that can link with another in the list: two sets that share a rare token meet in its
list, so what meets in a list of frequent combinations shares frequent tokens only, and must have enough of them.
Candidates then pass a lossless filter on sketches, the counts of a set's tokens in n / 4 buckets or so: the counts'
differences add up to no more than the tokens that two sets don't share. What is left is verified exactly on the sets,
read again from the texts for these classes only. First each class is compared with one leader of each of its lists,
the class with the least share of rare tokens, which of a group of near copies is the one with the fewest edits; that is
linear in the list. The links found are made components. Then, within each list, classes of different components are
compared, too, where a link is possible by their sizes, their frequent tokens and 256 bits of parities of token counts, as
unequal parities are no more than the tokens that two sets don't share. Classes of the same component have nothing to
add, so not all pairs of a list are emitted, and the components are exact.

Defined cases: null and empty texts have an empty set and link with nothing; rows with equal sets are linked whatever
their ids; a null id never is a component's id unless all are null; an empty table gives no rows; very long texts are
read in parts and give whole sets; ties of leaders go by hash, which changes no result; other columns are ignored by
components() and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, cut, drop_cut, map_batches
from palimpsest.llm.components import connected_components
from palimpsest.llm.shingles import mix, shingle_set

BLOCK, REPEATED, FREQUENT, MOST_FREQUENT = 4_000_000, 3, 24, 1 << 19
VERY_FREQUENT = 4096  # from here on tokens are indexed in triples
LONG = 16  # classes of a long list of a single token
PARITIES = ("p0", "p1", "p2", "p3")
REMEMBERED = 1 << 16  # classes of which a task knows that it has indexed them
WIDEST = 4096  # buckets of a sketch
PER_GROUP = {2: 15, 3: 9}  # tokens of a set for each group of tokens that are indexed in pairs or triples
PAIR, CLASS = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def slack(n: int, percent: int) -> int:
    """How many of a set's n tokens a partner may lack: it shares percent * n / 100 at least."""
    return n - -(-percent * n // 100)


def class_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def size_classes(percent: int) -> np.ndarray:
    """Least sizes of the size classes: sizes of partners are in the same class or in neighbouring ones."""
    out, x = [1], 1.0
    while x < 1e12:
        x *= 100 / percent
        if int(np.ceil(x)) > out[-1]:
            out.append(int(np.ceil(x)))
    return np.array(out)


def sketch(tokens: np.ndarray) -> bytes:
    """Counts, 255 at most, of the tokens by their lowest bits."""
    width = 16
    while width < min(len(tokens) // 4, WIDEST):
        width *= 2
    counts = np.bincount(((tokens >> np.uint64(1)) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def parities(tokens: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: whether the tokens of a bit, by their hashes, are an odd number."""
    odd = np.bincount(((tokens >> np.uint64(1)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(x: bytes, y: bytes, total: int, percent: int) -> bool:
    """Whether sets with these sketches and that many tokens together can be alike enough."""
    a, b = np.frombuffer(x, dtype=np.uint8).astype(np.int32), np.frombuffer(y, dtype=np.uint8).astype(np.int32)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.minimum(a.reshape(-1, len(b)).sum(axis=0), 255)
    return int(np.abs(a - b).sum()) * (100 + percent) <= total * (100 - percent)


def profile(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (doc_id, n, cid, the class, sketch and the parities p0 to p3) and, with token set, of tokens that
    repeat within a block."""
    source = as_bytes(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = {"n": pa.int64(), "cid": pa.int64(), "sketch": pa.binary(), **{f"p{k}": pa.int64() for k in range(4)}, "token": pa.int64(), "times": pa.int64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, doc_type = 0, pa.int64()

        def rows(n: int, given: dict) -> pa.RecordBatch:
            types = {"doc_id": doc_type, **fields}
            return pa.RecordBatch.from_pydict({c: pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in types.items()})

        def repeated() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            kept = counts >= REPEATED
            return rows(int(kept.sum()), {"token": tokens[kept].view(np.int64), "times": counts[kept]})

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            sizes, classes, sketches, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, size)
                sizes.append(len(tokens))
                classes.append(class_id(tokens))
                sketches.append(sketch(tokens))
                bits.append(parities(tokens))
                held.append(tokens)
                total += len(tokens)
                if total >= BLOCK:
                    yield repeated()
                    held, total = [], 0
            columns = np.stack(bits).T.copy() if bits else np.zeros((4, 0), dtype=np.int64)
            yield rows(batch.num_rows, {"doc_id": batch.column("doc_id"), "n": sizes, "cid": classes, "sketch": sketches, **{f"p{k}": columns[k] for k in range(4)}})
        if held:
            yield repeated()

    return map_batches(source, scan, f"doc_id {kind}, n long, cid long, sketch binary, p0 long, p1 long, p2 long, p3 long, token long, times long")


@dataclass(frozen=True)
class Frequent:
    """Frequent tokens: their sorted hashes, their places in the order by count, and the place of the first very frequent."""

    tokens: np.ndarray
    rank: np.ndarray
    very: int

    @classmethod
    def of(cls, tokens: np.ndarray, times: np.ndarray) -> Frequent:
        by_count = np.lexsort((tokens, times))
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[by_count] = np.arange(len(tokens))
        by_hash = np.argsort(tokens)
        return cls(tokens[by_hash], rank[by_hash], int((times < VERY_FREQUENT).sum()))

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token in the order, -1 if it is rare."""
        if not len(self.tokens):
            return np.full(len(tokens), -1, dtype=np.int64)
        slot = np.searchsorted(self.tokens, tokens)
        slot[slot == len(self.tokens)] = 0
        return np.where(self.tokens[slot] == tokens, self.rank[slot], -1)


def combinations(tokens: np.ndarray, group: np.ndarray, k: int, salt: np.uint64) -> list[np.ndarray]:
    """Hashes, odd, of each k tokens (2 or 3) of a group; tokens are in the global order within each group."""
    out = []
    longest = int(np.bincount(group).max()) if len(group) else 0
    for last in range(k - 1, longest):
        same = group[last:] == group[:-last]
        for middle in range(1, last) if k == 3 else (0,):
            h = mix(tokens[:-last][same] * PAIR + salt)
            if k == 3:
                h = mix(h * PAIR + tokens[middle : middle - last][same])
            out.append(mix(h + tokens[last:][same]) | np.uint64(1))
    return out


def signatures(tokens: np.ndarray, frequent: Frequent, percent: int, classes: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set (sorted hashes) is indexed by, and how many of its tokens are frequent.

    Signatures of single tokens are even, as tokens are; those of combinations are odd.
    """
    need = slack(len(tokens), percent) + 1
    place = frequent.places(tokens)
    rare = tokens[place < 0][:need]
    many = int((place >= 0).sum())
    need -= len(rare)
    if not need:
        return rare, many
    order = np.argsort(place, kind="stable")[len(tokens) - many :]
    ordered, triple = tokens[order], place[order] >= frequent.very
    out = [rare]
    own = int(np.searchsorted(classes, len(tokens), side="right")) - 1
    for size_class in (own, own + 1):
        group, counts = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=bool)
        for k, of in ((2, ~triple), (3, triple)):
            group[of] = (mix(ordered[of] ^ PAIR) % np.uint64(1 + int(classes[size_class]) // PER_GROUP[k])).astype(np.int64)
            counts[of] = occurrence(group[of]) >= k - 1
        end = int(np.searchsorted(np.cumsum(counts), need)) + 1  # all, where even they don't suffice (sets that link with nothing else)
        salt = mix(np.array([size_class], dtype=np.uint64) ^ CLASS)[0]
        for k, of in ((2, ~triple[:end]), (3, triple[:end])):
            by_group = np.argsort(group[:end][of], kind="stable")
            out += combinations(ordered[:end][of][by_group], group[:end][of][by_group], k, salt + np.uint64(k))
    return np.concatenate(out), many


def occurrence(values: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(values, kind="stable")
    firsts = np.flatnonzero(np.diff(values[order], prepend=-1))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(values)) - np.repeat(firsts, np.diff(firsts, append=len(values)))
    return out


def index(docs: DataFrame, frequent: Frequent, size: int, percent: int, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """The inverted index: rows of sig and cid; and a row of cid and frequent, how many of its tokens are, for each class.

    A task emits a class again only after many others, so that copies make few rows. wanted: hashes (h) of the ids whose
    documents are to be indexed; some others may be, too.
    """
    context = docs.sparkSession.sparkContext
    shared, chosen = context.broadcast(frequent), None if wanted is None else context.broadcast(id_filter(wanted))
    classes = size_classes(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        seen: set[int] = set()
        for whole in batches:
            if chosen is not None:
                whole = whole.filter(pa.array(may_be_in(chosen.value, whole.column("h").to_numpy())))
            for start in range(0, whole.num_rows, 128):
                sigs, cids, own, many = [np.zeros(0, dtype=np.uint64)], [], [], []
                for text in whole.column("text").slice(start, 128).to_pylist():
                    tokens = shingle_set(text, size)
                    cid = class_id(tokens)
                    if not len(tokens) or cid in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(cid)
                    found, n = signatures(tokens, frequent, percent, classes)
                    sigs.append(found)
                    cids.append(np.full(len(found), cid, dtype=np.int64))
                    own.append(cid)
                    many.append(n)
                none = np.zeros(0, dtype=np.int64)
                sig = np.concatenate(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate([none, *cids])), pa.nulls(len(sig), pa.int64())], names=["sig", "cid", "frequent"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(own, pa.int64()), pa.array(many, pa.int64())], names=["sig", "cid", "frequent"])

    source = as_bytes(docs, id_col, text_col)
    source = source.select("text") if wanted is None else source.select("text", id_hash().alias("h"))
    return map_batches(source, emit, "sig long, cid long, frequent long")


def frequent_tokens(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with the largest counts (columns token and times), `most` at most, and these."""
    # The least count from which on there are `most` tokens at most; counts are grouped by powers, so these are few rows.
    step = F.floor(F.log2("times") * 8)
    tally = sorted(((r["step"], r["count"]) for r in counted.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in tally:
        if total + n > most:
            break
        least, total = at, total + n
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = counted.where(step >= least).toArrow()
    return rows.column("token").to_numpy().view(np.uint64), rows.column("times").to_numpy()


def indexed(docs: DataFrame, scanned: DataFrame, classes: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The index, and the signatures of several classes in it."""
    counted = scanned.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times"))
    tokens, times = frequent_tokens(cut(counted.where(F.col("times") >= FREQUENT)), MOST_FREQUENT)
    entries = cut(index(docs, Frequent.of(tokens, times), size, percent, id_col, text_col))
    single = entries.where(F.col("sig") % 2 == 0).groupBy(F.col("sig").alias("token")).agg(F.count("*").alias("times"))
    more, counts = frequent_tokens(cut(single.where(F.col("times") >= LONG)), MOST_FREQUENT - len(tokens))
    if len(more):
        frequent = Frequent.of(np.concatenate([tokens, more]), np.concatenate([times, counts]))
        long = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"sig": more.view(np.int64)})))  # MOST_FREQUENT rows at most
        members = entries.join(long, "sig", "left_semi").select("cid").distinct()
        ids = classes.join(members, "cid").select(id_hash("least_id").alias("h"))
        # Members that are indexed again for another's sake, as their ids' hashes are alike, only repeat their rows.
        fresh = cut(index(docs, frequent, size, percent, id_col, text_col, cut(ids)))
        entries = entries.join(long, "sig", "left_anti").unionByName(fresh)
    return entries, shared_signatures(entries)


def shared_signatures(entries: DataFrame) -> DataFrame:
    """sig and times of signatures that several classes have, written."""
    lists = entries.where("sig IS NOT NULL").groupBy("sig").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("times"))
    return cut(lists.where("lo <> hi").select("sig", "times"))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches don't rule a link out."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(one, "a").join(other, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sa", "sb", "total")]
            mask = pa.array([may_link(x, y, n, percent) for x, y, n in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return map_batches(sized.select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("total")), check, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. The joins are on one class each, and split where one has very many pairs."""
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                shared = int((t[at] == s).sum())
                kept.append(100 * shared >= percent * (len(s) + len(t) - shared))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return map_batches(both.select("a", "b", "ta", "tb"), check, "a long, b long")


def id_filter(ids: DataFrame, most_bits: int = 1 << 26) -> tuple[int, np.ndarray]:
    """A Bloom filter of the ids (column h, hashed), of eight bits an id but most_bits at most, made by the executors."""
    bits = 1 << 16
    n = ids.count()
    while bits < 8 * n and bits < most_bits:
        bits *= 2
    at = F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftright("h", 32), F.lit(bits))))
    words = ids.select(at.alias("at")).select(F.floor(F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, int(at % 64))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bits, table


def id_hash(column: str = "doc_id") -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\0")))


def may_be_in(filter: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    bits, table = filter
    found = np.ones(len(h), dtype=bool)
    for at in (h % bits, (h >> 32) % bits):
        found &= (table[at // 64] >> (at % 64)) & 1 == 1
    return found


def token_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """cid and tokens (bytes of the sorted hashes) of the wanted classes; wanted: doc_id (of one member) and cid.

    Where texts are read, a Bloom filter of the wanted ids chooses the few whose sets are moved.
    """
    wanted = cut(wanted.select(id_hash().alias("h"), "cid"))
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(may_be_in(shared.value, whole.column("h").to_numpy())))
            for start in range(0, whole.num_rows, 128):
                sets = [shingle_set(text, size) for text in whole.column("text").slice(start, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([class_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cid", "tokens"])

    source = as_bytes(docs, id_col, text_col).select(id_hash().alias("h"), "text")
    return map_batches(source, emit, "cid long, tokens binary").join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that link, written."""
    near = cut(plausible(pairs, classes, percent))
    ends = near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct()
    wanted = ends.join(classes, "cid").select(F.col("least_id").alias("doc_id"), "cid")
    sets = cut(token_sets(docs, wanted, size, id_col, text_col))
    links = cut(verified(near, sets, percent))
    drop_cut(sets)
    return links


def posting_lists(entries: DataFrame, several: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """sig, cid, n and frequent of the lists with several classes, each class once, without those whose frequent tokens
    are too few for a link with any other set of the list; written."""
    lists = cut(entries.select("sig", "cid").join(several.select("sig"), "sig").distinct().join(classes.select("cid", "n", "frequent"), "cid"))
    least = lists.groupBy("sig").agg(F.min("n").alias("least"))
    enough = (F.col("sig") % 2 == 0) | ((100 + percent) * F.col("frequent") >= percent * (F.col("n") + F.col("least")))
    return cut(lists.join(least, "sig").where(enough).drop("least"))


def leaders(lists: DataFrame) -> DataFrame:
    """sig and lead: of each list, the class that most likely is alike most others, having the least share of rare tokens."""
    others = F.floor(1000 * (F.col("n") - F.col("frequent")) / F.col("n")).cast("long")
    order = F.shiftleft(others, 48) + F.shiftrightunsigned(F.xxhash64("cid"), 16)
    return lists.groupBy("sig").agg(F.min_by("cid", order).alias("lead"))


def components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, cid (equal for equal sets) and root (equal within a
    component and in no other, which ids that are null or repeated can't tell; null for empty sets)."""
    scanned = cut(profile(docs, size, id_col, text_col))
    rows = scanned.where("token IS NULL").select("doc_id", "n", "cid")
    classes = cut(scanned.where("token IS NULL AND n > 0").groupBy("cid").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("n", "sketch", *PARITIES)]))
    entries, several = indexed(docs, scanned, classes, size, percent, id_col, text_col)
    classes = cut(classes.join(entries.where("sig IS NULL").groupBy("cid").agg(F.max("frequent").alias("frequent")), "cid"))
    lists = posting_lists(entries, several, classes, percent)
    for part in (entries, several):
        drop_cut(part)
    stars = lists.join(leaders(lists), "sig").where("cid <> lead").select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b"))
    stars = cut(stars.distinct())
    links = linked(docs, stars, classes, size, percent, id_col, text_col)
    roots = cut(connected_components(links))
    of = lists.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = of.groupBy("sig").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("sig")
    rest = cut(of.join(mixed, "sig").join(classes.select("cid", *PARITIES), "cid"))
    a, b = rest.alias("a"), rest.alias("b")
    total = F.col("a.n") + F.col("b.n")
    alike = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    enough = (F.col("a.sig") % 2 == 0) | ((100 + percent) * F.least("a.frequent", "b.frequent") >= percent * total)
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITIES), F.lit(0))
    near = (100 + percent) * apart <= (100 - percent) * total
    across = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.cid") < F.col("b.cid")) & (F.col("a.root") != F.col("b.root")) & alike & enough & near)
    pairs = across.select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).distinct()
    pairs = cut(pairs.join(stars, ["a", "b"], "left_anti"))
    more = linked(docs, pairs, classes, size, percent, id_col, text_col)
    if not more.isEmpty():
        roots = cut(connected_components(links.unionByName(more)))
    placed = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least_id", F.coalesce("root", "cid").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = placed.join(named, "root").select("cid", "component_id", "root")
    return rows.join(by_class, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "cid", "root")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their own columns, one document of each component: that with the least id, and of equal ids any one of
    those with equal texts. Documents without words are no one's duplicates and all stay.
    """
    found = components(docs, size, percent, id_col, text_col)
    kept = cut(found.where(F.col("n_shingles") > 0).groupBy("root").agg(F.min(F.struct("doc_id", "cid")).alias("k")).select("k.doc_id", "k.cid"))
    columns = docs.columns

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids = [class_id(shingle_set(x, size)) for x in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "__text"), pa.array(cids, pa.int64())], names=[*(c for c in batch.schema.names if c != "__text"), "__cid"])

    def named(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit("\0")).alias("__id")

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), named(id_col), F.col(text_col).cast("binary").alias("__text"))
    tagged = map_batches(source, tag, source.drop("__text").withColumn("__cid", F.lit(0).cast("long")).schema)
    # The join already has rows of a key together, so that dropping repeated ones moves nothing.
    chosen = tagged.join(kept.select(named("doc_id"), F.col("cid").alias("__cid")), ["__id", "__cid"]).dropDuplicates(["__id", "__cid"])
    wordless = tagged.where(F.col("__cid") == class_id(np.zeros(0, dtype=np.uint64)))
    return chosen.select("row.*").unionByName(wordless.select("row.*"))
