"""Language identification, toxicity and language-model scores: what they learn, and their defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import common, langid, lm, toxicity


def test_language(spark, docs, empty):
    model = langid.Model([("the", "en", 50), ("river", "en", 5), ("near", "en", 4), ("der", "de", 50), ("straße", "de", 6), ("fluss", "de", 5)])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert found[1] == found[2] == found[3] == found[4] == ("und", 0.0)
    assert found[5][0] == "en" and found[10][0] == "de" and all(0 <= s <= 1 for _, s in found.values())
    assert langid.identify(docs, model).count() == docs.count() and langid.identify(empty, model).count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {1, 2, 3, 4} & {r["doc_id"] for r in kept.collect()}
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.where("FALSE"))).collect()} == {"und"}


def test_backoff_goes_from_words_to_shorter_grams():
    model = langid.Model([("the", "en", 5), ("thing", "en", 5), ("der", "de", 5)])
    assert np.argmax(model.backoff("things")) == model.languages.index("en")
    assert model.backoff("中文") is not None  # `<` and `>` are known
    scorer = langid.Scorer(model, remembered=3)
    assert scorer.predict(b"things derb thinge dern therm") == langid.Scorer(model).predict(b"things derb thinge dern therm")


def test_language_learns_every_language(spark):
    def own(k):
        return "".join(chr(97 + k // 26**i % 26) for i in range(3)) * 2

    df = spark.createDataFrame([(k, own(k), f"l{k:04}") for k in range(1100)], "doc_id long, text string, lang string")
    assert len(langid.fit(df).languages) == 1100


def test_language_on_held_out(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(df.where(held_out), langid.fit(df.where(~held_out))).join(df.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_toxicity_catches_unseen_misspellings(spark, docs, empty):
    rng = np.random.default_rng(1)
    clean, bad = [f"w{k}or" for k in range(80)], ["idiot", "moron", "trash"]
    rows = []
    for k in range(400):
        words = list(rng.choice(clean, rng.integers(5, 60)))
        if k % 4 == 0:
            words[:2] = rng.choice(bad, 2)
        rows.append((k, " ".join(words), k % 4 == 0))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(x)) for k, _, x in rows] + [(9999, None), (9998, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, buckets=1 << 12, steps=60)
    scorer = toxicity.Scorer(model)
    assert scorer.score(b"w1or w2or idiiot w3or morron w5or") > 0.7 > 0.3 > scorer.score(b"w1or w2or w3or w4or w5or w6or")
    found = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert found[1] == found[2] == found[4] < 0.5 and all(0 <= s <= 1 for s in found.values())
    assert toxicity.scores(empty, model).count() == 0
    assert {r["score"] for r in toxicity.scores(docs, toxicity.fit(df, labels.where("FALSE"))).collect()} == {0.0}


def words(text):
    return (text or "").encode().lower().split()


def test_language_model(spark, docs, empty, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs.where("doc_id IS NOT NULL").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    train = df.where("doc_id % 5 <> 1")
    found = lm.score(df, train, head=500, shortlist=100).collect()
    counts = Counter()
    for r in train.collect():
        counts.update(words(r["text"]))
        counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    texts = dict(df.collect())
    assert len(found) == df.count()
    for r in found:
        tokens = [*words(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9, abs_tol=1e-9)
    held_out = [r for r in found if r["doc_id"] % 5 == 1]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)
    assert lm.score(empty, train, head=500).count() == 0
    alone = lm.score(docs, empty).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["score"] <= 0 for r in alone)


def test_scores_equal_a_plain_evaluation(spark, docs, monkeypatch):
    """Token by token, with the model that was trained: the output's probability by the chain of groups, times the share
    within the output's class."""
    kept = {}
    real = lm.mean_of_shards
    monkeypatch.setattr(lm, "mean_of_shards", lambda *a, **k: kept.setdefault("models", []).append(real(*a, **k)) or kept["models"][-1])
    vocabulary = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda *a: kept.setdefault("v", vocabulary(*a)))
    train = docs.where("doc_id > 4 OR doc_id IS NULL")
    found = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs, train, shortlist=9, tails=4, head=20).collect()}
    model, v = kept["models"][-1], kept["v"]
    counts = Counter(w for r in train.collect() for w in words(r["text"]))
    listed = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]

    def soft(logits, k):
        return math.log10(math.exp(logits[k]) / sum(math.exp(x) for x in logits))

    for r in docs.collect():
        total, before = 0.0, [v.outputs] * 4
        for w in [*words(r["text"]), None]:
            share = 0.0
            if w is None:
                out = v.end
            elif w in listed[:9]:
                out = v.output[v.ids[w]]
            else:
                k = lm.tail_class(w, 4)
                own = [c for x, c in counts.items() if x not in listed[:9] and lm.tail_class(x, 4) == k]
                out, share = v.tails[k], math.log10((counts[w] + 0.5) / (sum(own) + 0.5 * (len(own) + 1)))
            q = sum(model.contexts[j][before[j]].astype(float) for j in range(4))
            g = int(model.group[out])
            total += share + soft([float(q @ u + b) for u, b in zip(model.groups, model.group_bias, strict=True)], g)
            inside = range(model.starts[g], model.stops[g])
            total += soft([float(q @ model.targets[k] + model.bias[k]) for k in inside], out - model.starts[g])
            before = [int(out), *before[:3]]
        assert math.isclose(found[r["doc_id"], len(words(r["text"])) + 1], total, rel_tol=1e-4, abs_tol=1e-3)


def test_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    """One partition or seven, several shards, long documents in parts."""
    monkeypatch.setattr(lm, "SHARD", 9000)
    monkeypatch.setattr(lm, "PART", 500)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, seven = ({r["doc_id"]: r["score"] for r in lm.score(d, d.where("doc_id % 5 <> 1"), head=500, shortlist=100).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one.keys() == seven.keys() and all(math.isclose(one[k], seven[k], rel_tol=1e-4) for k in one)


def test_probabilities_add_up():
    """Over all outputs for any context."""
    counts = np.array([90.0, 50, 40, 9, 8, 7, 3, 2, 1, 1])
    model = lm.Model.fresh(counts, 6)
    assert len(model.starts) == 3 and model.stops[-1] == 10
    before = np.array([[0, 1, 2, 10]] * 10)
    assert math.isclose(np.exp(model.log_probabilities(before, np.arange(10))).sum(), 1, rel_tol=1e-5)
    model.bias += 200  # too large to exponentiate as it is
    assert math.isclose(np.exp(model.log_probabilities(before, np.arange(10))).sum(), 1, rel_tol=1e-3)
    untrained = np.exp(lm.Model.fresh(counts, 6).log_probabilities(np.full((10, 4), 10), np.arange(10)))
    assert np.allclose(untrained, (counts + 0.5) / (counts + 0.5).sum(), rtol=0.5)


def test_training_follows_the_data():
    outputs = np.tile(np.array([1, 2, 3, 4, 5, 0]), 6000)
    model = lm.Model.fresh(np.array([6000.0] * 6), 8)
    before = lm.contexts_of(outputs, 6)
    trained = model.train(before, outputs, 0.1, 5)
    assert trained.log_probabilities(before, outputs).mean() > -0.3 > model.log_probabilities(before, outputs).mean()


def test_training_sees_every_position(docs, monkeypatch):
    """All (context, target) pairs of all training documents, each once over all rounds, those of long ones too."""
    trained, real = [], lm.mean_of_shards

    def noted(model, shards, n_shards, rate, turn, rounds):
        for r in shards.collect():
            before, target = lm.positions_of(np.frombuffer(r["outputs"], dtype="<u2"), len(model.output_counts), turn, rounds)
            trained.extend(map(tuple, np.concatenate([before, target[:, None]], axis=1).tolist()))
        return real(model, shards, n_shards, rate, turn, rounds)

    monkeypatch.setattr(lm, "mean_of_shards", noted)
    monkeypatch.setattr(lm, "SHARD", 500)
    kept = []
    vocabulary = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda *a: kept.append(vocabulary(*a)) or kept[-1])
    found = lm.score(docs.limit(1), docs).collect()
    v, expected = kept[0], Counter()
    for r in docs.select("text").collect():
        outputs = np.append(v.outputs_of(words(r["text"]))[1], v.end)
        expected.update(map(tuple, np.concatenate([lm.contexts_of(outputs, v.outputs), outputs[:, None]], axis=1).tolist()))
    assert Counter(trained) == expected and len(trained) == found[0]["train_tokens"]


def test_rounds_share_out_all_positions():
    texts = [[7, 8, 9, 0], [0], [3, 0], list(range(1, 30)) + [0]]
    marked = [np.array(x, dtype=np.uint16) for x in ([50] * 4 + texts[0], [50] * 4 + texts[1], [50] * 4 + texts[2], [50] * 4 + texts[3][:20], [y | 1 << 15 for y in texts[3][16:20]] + texts[3][20:])]
    stream = np.concatenate(marked)  # the last text in two parts
    expected = Counter((*b, t) for x in texts for b, t in zip(lm.contexts_of(np.array(x), 50).tolist(), x, strict=True) for b in [tuple(b)])
    found = Counter()
    for turn in range(3):
        before, target = lm.positions_of(stream, 50, turn, 3)
        found.update((*b, t) for b, t in zip(map(tuple, before.tolist()), target.tolist(), strict=True))
    assert found == expected


def test_contexts():
    assert lm.contexts_of(np.array([7, 8, 9]), 5).tolist() == [[5, 5, 5, 5], [7, 5, 5, 5], [8, 7, 5, 5]]
    assert lm.tail_class(b"...", 64) == zlib.crc32(b"..") % 64


def test_texts_are_read_in_parts(monkeypatch):
    """Cut at any ASCII white space; words are never cut, and models see them all."""
    text = "one two\nthree\tfour\x0bfive\x0csix\rseven" + "eight" * 30 + " Ünï nine"
    model = langid.Model([("one", "en", 5), ("zwei", "de", 5), ("five", "en", 3)])
    rng = np.random.default_rng(1)
    toxic = toxicity.Model(rng.normal(size=(64, 2)), rng.normal(size=(2, 2)), np.zeros(2))
    whole = [list(lm.words(text.encode())), langid.Scorer(model).predict(text.encode()), toxicity.Scorer(toxic).score(text.encode())]
    for size in (1, 5, 9, 40):
        monkeypatch.setattr(common, "CHUNK", size)
        parts = list(common.split_at_space(text.encode()))
        assert len(parts) >= 3 and b" ".join(parts).split() == text.encode().split()
        assert [w for part in lm.words(text.encode()) for w in part] == whole[0][0]
        lang, score = langid.Scorer(model).predict(text.encode())
        assert lang == whole[1][0] and math.isclose(score, whole[1][1], rel_tol=1e-6)
        assert math.isclose(toxicity.Scorer(toxic).score(text.encode()), whole[2], rel_tol=1e-9)


def test_language_equals_a_plain_evaluation():
    """Word by word: a known one's log frequencies, or the mean of its longest known n-grams', whatever its length."""
    rng = np.random.default_rng(2)
    counts = [("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))), lang, int(rng.integers(1, 50))) for lang in ("x", "y", "z") for _ in range(40)]
    counts = [(w, lang, n) for (w, lang), n in {(w, lang): n for w, lang, n in counts}.items()]
    model = langid.Model(counts, max_grams=150)
    langs = ["x", "y", "z"]
    table = {w: [sum(n for v, k, n in counts if (v, k) == (w, lang)) for lang in langs] for w, _, _ in counts}
    totals = [sum(n for _, k, n in counts if k == lang) for lang in langs]

    def of_word(w):
        if w in table:
            return [math.log((table[w][k] + 0.5) / (totals[k] + 0.5 * (len(table) + 1))) for k in range(3)]
        marked = f"<{w}>"
        for n in range(5, 0, -1):
            known = [model.gram_vectors[model.gram_rows[g]] for g in (marked[k : k + n] for k in range(len(marked) - n + 1)) if g in model.gram_rows]
            if known:
                return [float(np.mean([v[k] for v in known])) for k in range(3)]
        return [0.0] * 3

    texts = [" ".join(rng.choice([*table, "aab", "q", "é" * 200, "abc" * 70 + "dd"], 12)) for _ in range(30)]
    for text in texts:
        sums = np.sum([of_word(w) for w in text.split()], axis=0)
        lang, score = langid.Scorer(model).predict(text.encode())
        assert lang == langs[int(np.argmax(sums))] and math.isclose(score, 1 / sum(math.exp(s - max(sums)) for s in sums), rel_tol=1e-3)


def test_long_words_are_learned_and_read_whole(spark):
    """What tells two languages apart, or a toxic text, stands behind the 200th letter."""
    long = lambda c, end: c * 200 + end
    rows = [(k, long("a", "wxyz" if k % 2 else "mnop"), "en" if k % 2 else "de") for k in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.Scorer(model).predict(long("a", "awxyz").encode())[0] == "en" and langid.Scorer(model).predict(long("a", "amnop").encode())[0] == "de"
    everything = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=None, max_grams=None)
    assert everything.rows.keys() == model.rows.keys()
    toxic = toxicity.Model(np.random.default_rng(3).normal(size=(1 << 12, 2)), np.eye(2), np.zeros(2))
    assert toxic.word_logit(long("a", "bad")) != toxic.word_logit(long("a", "dab"))


def test_toxicity_equals_a_plain_evaluation():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=(97, 3)), rng.normal(size=(3, 2)), rng.normal(size=2))
    for text in ("", "Some wörds some", "x " * 50, "a" * 300 + " b"):
        vectors = [np.zeros(3)] * toxicity.EMPTY
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            m = f"<{w}>"
            pieces = [m, *(m[k : k + n] for n in (3, 4, 5) for k in range(len(m) - n + 1))]
            vectors.append(np.mean([model.embeddings[zlib.crc32(p.encode()) % 97] for p in pieces], axis=0))
        logits = np.mean(vectors, axis=0) @ model.weights + model.bias
        assert math.isclose(toxicity.Scorer(model).score(text.encode()), math.exp(logits[1]) / np.exp(logits).sum(), rel_tol=1e-4)
