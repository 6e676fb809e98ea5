import random

import numpy as np
import pytest

from palimpsest.llm import jaccard as J
from palimpsest.llm.components import connected_components
from palimpsest.llm.shingles import shingle_set


def brute_force(rows, size=5, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((str(doc), len(sets[k]), least.get(find(k))) for k, (doc, _) in enumerate(rows))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.components(df).collect())


def test_edge_cases(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == [(d, n, int(d) if n == 0 else c) for d, n, c in brute_force(rows)]
    assert J.components(empty).count() == 0


@pytest.mark.parametrize(("frequent", "very", "long"), [(J.FREQUENT, J.VERY_FREQUENT, J.LONG), (3, 1000, 1000), (3, 6, 1000), (1000, 8, 2)])
def test_equals_brute_force(spark, monkeypatch, frequent, very, long):
    """Groups of near copies and shared passages; with low thresholds nearly everything is frequent, or very frequent, or
    becomes so once its list is long."""
    for name, value in {"FREQUENT": frequent, "VERY_FREQUENT": very, "LONG": long}.items():
        monkeypatch.setattr(J, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 60, 120]))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute_force(rows)


def test_signatures_are_shared_by_linked_sets():
    """Even if all tokens are frequent, sets at the limit of similarity share a signature."""
    rng = np.random.default_rng(2)
    classes = J.size_classes(80)
    for n in [4, 5, 9, 10, 23, 60, 200, 999]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64) * np.uint64(2))
            lost = J.slack(len(a), 80)
            b = np.sort(rng.permutation(a)[: len(a) - lost])
            for tokens in (np.zeros(0, dtype=np.uint64), a, a[::2].copy()):
                for most in (100, 5000, 10_000):
                    frequent = J.Frequent.of(tokens, rng.integers(24, most, len(tokens)))
                    (x, nx), (y, ny) = (J.signatures(s, frequent, 80, classes) for s in (a, b))
                    assert np.intersect1d(x, y).size
                    assert (nx, ny) == tuple(np.isin(s, tokens).sum() for s in (a, b))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in [5, 50, 500, 30_000]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a[: len(a) - J.slack(len(a), 80)]
        assert J.may_link(J.sketch(a), J.sketch(b), len(a) + len(b), 80)
        apart = sum(int(x).bit_count() for x in (J.parities(a) ^ J.parities(b)).view(np.uint64))
        assert 180 * apart <= 20 * (len(a) + len(b)) and apart <= len(a) - len(b)
    assert not J.may_link(J.sketch(a), J.sketch(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))), 2 * n, 80) or n > 20_000


def test_shingles_of_long_texts_are_those_of_parts(monkeypatch):
    import palimpsest.llm.shingles as S

    text = " ".join(f"word{k}" for k in range(5000)).encode()
    whole = shingle_set(text)
    monkeypatch.setattr(S, "CHUNK", 100)
    assert np.array_equal(whole, shingle_set(text)) and len(whole) == 4996
    assert not len(shingle_set(None)) and not len(shingle_set(b" \n")) and len(shingle_set(b"a b")) == 1


def test_components_of_a_long_path(spark):
    edges = [(k + 1, k) for k in range(60)] + [(100, 100), (101, 100), (101, 100)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_keep_one(docs):
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "10", "None"])


def test_keep_one_with_null_and_repeated_ids(spark):
    """What links decides, not the ids: unlinked texts all stay, of linked ones a single one does."""
    texts = [" ".join(f"{name}{k}" for k in range(30)) for name in "abcdefg"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (8, texts[3]), (8, texts[4]), (8, texts[4]), (9, texts[5]), (9, texts[5] + " more"), (10, texts[6]), (None, None), (8, "")]
    kept = [tuple(r) for r in J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    linked = [k for k in kept if k[0] == 9]
    assert len(linked) == 1 and linked[0] in rows
    expected = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (8, texts[3]), (8, texts[4]), (10, texts[6]), (None, None), (8, "")]
    assert sorted(map(repr, set(kept) - set(linked))) == sorted(map(repr, expected)) and len(kept) == len(expected) + 1


def test_joins_of_large_groups_stay_linear(spark, monkeypatch):
    """A group of near copies and a passage in many otherwise different documents: what is left to compare after the
    leaders follows the documents, not the pairs within a list; the components are those of the brute force."""
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(5000)}"
    base, passage, rows = [word() for _ in range(200)], [word() for _ in range(40)], []
    for edits in [0] + [rng.choice([1, 2, 3, 4, 8, 12]) for _ in range(299)]:
        copy = list(base)
        for k in rng.sample(range(200), edits):
            copy[k] = word()
        rows.append((len(rows), " ".join(copy)))
    for _ in range(300):
        rows.append((len(rows), " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])))
    compared = []
    linked = J.linked
    monkeypatch.setattr(J, "linked", lambda docs, pairs, *rest: compared.append(pairs.count()) or linked(docs, pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute_force(rows)
    assert compared[0] <= 10 * len(rows) and compared[1] <= 10 * len(rows)
