from palimpsest.llm import decontaminate as D
from palimpsest.llm.decontaminate import TO_WORDS


def words(text):
    return [] if text is None else text.encode().translate(TO_WORDS).split()


def brute_force(docs, items, n=13):
    windows = []
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        windows += [(item, w[k : k + size]) for k in range(len(w) - size + 1) if size]
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def result(found):
    return {r["doc_id"]: (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["items"]) for r in found.collect()}


def test_equals_brute_force(spark, docs):
    items = [(1, "fox jumps over the lazy dog near the river bank today and more words follow here"), (2, "one two"), (3, None), (4, "?!"), (5, "quick brown fox jumps over the lazy dog near the river bank today"), (6, "end"), (7, "straße naïve")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_force([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items)
    assert result(D.find_overlaps(docs, table)) == expected
    assert result(D.find_overlaps(docs, table, slice_bytes=100)) == expected  # several slices
    assert expected[5][1] > 0 and expected[7][2] == ["2"]


def test_no_items_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(h == 0 and not i for _, h, i in result(D.find_overlaps(docs, none)).values())
    assert D.find_overlaps(empty, none).count() == 0


def test_actions_keep_columns(spark, docs):
    items = spark.createDataFrame([(1, "one two"), (2, "brown fox")], "item_id long, text string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 8, 9, 10, None}
    cleaned = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, action="spans").collect()}
    assert cleaned[7] == "" and cleaned[5].startswith("The quick  jumps") and cleaned[1] is None and len(cleaned) == 11


def test_items_with_a_null_id_hit_words(spark, docs, tmp_path):
    """They count as one item without a name, as in the query's SQL."""
    from palimpsest.llm.queries import op8_decontaminate

    items = [(None, "fox jumps over the lazy dog near the river bank today"), (None, "quick brown fox jumps"), (4, "lazy dog"), (None, "two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"slice_bytes": 100}):
        found = result(D.find_overlaps(docs, table, **options))
        assert found[5] == (14, 13, ["4", None]) and found[7] == (2, 1, [None]) and found[10][1:] == (0, [])
    kept = {r["doc_id"] for r in D.decontaminate(docs, table).collect()}
    assert not {5, 6, 7} & kept and {1, 2, 3, 4, 8, 9, 10} <= kept
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in op8_decontaminate(spark, str(tmp_path)).collect()}
    sha = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of the empty text
    assert (rows[7]["n_hit"], rows[7]["n_items"], rows[7]["items_sha256"], rows[7]["contaminated"]) == (1, 1, sha, True)
    assert rows[5]["n_items"] == 2


def test_least_run_drops_long_documents(spark):
    """A whole window in a long document, which is less than a twentieth of it; short items' words are not enough."""
    item = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"z{k}" for k in range(2000))
    rows = [(1, f"{long} {item} {long}"), (2, long), (3, f"{long} {' '.join(item.split()[:13])}"), (4, f"{long} {' '.join(item.split()[:12])}"), (5, f"{long} yes {long} yes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "yes")], "item_id long, text string")
    kept = lambda **options: sorted(r["doc_id"] for r in D.decontaminate(docs, items, **options).collect())
    assert kept() == [1, 2, 3, 4, 5] and kept(least_run=13) == [2, 4, 5] and kept(least_run=20) == [2, 3, 4, 5]


def test_long_texts_are_read_in_parts(monkeypatch):
    from palimpsest.llm import common

    text = (("a b c\n" * 50 + "the hidden\titem words here ") * 3).encode()
    index = D.WindowIndex([("x", b"hidden item words"), (None, b"c the"), ("y", b"hidden item words")], 13)

    def scanned():
        words = [w for part in common.split_at_space(text.translate(TO_WORDS)) for w in part.split()]
        return [m.tolist() if hasattr(m, "tolist") else m for m in index.scan(D.np.array([index.vocabulary.get(w, 0) for w in words], dtype="uint32"))]

    whole = scanned()
    monkeypatch.setattr(common, "CHUNK", 7)
    assert scanned() == whole and sum(whole[0]) == 15 and whole[1] == {"x", "y", None}
