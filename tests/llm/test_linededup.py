import random
import re
import unicodedata

from palimpsest.llm import linededup as L

PASSAGE = " ".join(f"word{k}" for k in range(60))


def brute_force(rows, lines=4, sentences=8):
    """Stretches to remove, by document."""
    seen, found = {}, {}
    for doc, text in rows:
        for start, end, *digest in L.units(text or "", lines, sentences):
            place = (doc is not None, doc or 0, start)
            seen[tuple(digest)] = min(seen.get(tuple(digest), place), place)
    for doc, text in rows:
        for start, end, *digest in L.units(text or "", lines, sentences):
            if (doc is not None, doc or 0, start) != seen[tuple(digest)]:
                found.setdefault(doc, set()).update(range(start, end))
    return {d: "".join(c for k, c in enumerate(t or "") if k not in found.get(d, ())) if t is not None else None for d, t in rows}


def test_equals_brute_force(spark, docs, empty):
    rows = [(20, f"First line of text here.\n{PASSAGE}\nlast one"), (21, f"Own words before. {PASSAGE}. And after it.\n{PASSAGE.upper()}\nFIRST  line of TEXT here."), (22, f"Other. {PASSAGE}. And after it."), (23, "a b\na b\na b"), (24, "same line with words\nsame line with words\n")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute_force([(r["doc_id"], r["text"]) for r in both.collect()])
    found = L.deduplicate(both).collect()
    assert len(found) == both.count()
    assert {r["doc_id"]: r["text"] for r in found} == expected
    by_id = {r["doc_id"]: r for r in found}
    assert PASSAGE.upper() not in by_id[21]["text"] and PASSAGE in by_id[20]["text"] and PASSAGE not in by_id[22]["text"]
    assert by_id[23]["n_removed"] == 0 and by_id[24]["text"] == "same line with words\n"
    for r in found:
        text = {**dict(docs.select("doc_id", "text").collect()), **dict(rows)}[r["doc_id"]]
        assert r["removed_chars"] == len(text or "") - len(r["text"] or "")
    assert L.deduplicate(empty).count() == 0


def test_hot_digests_take_the_broadcast_way(spark, monkeypatch):
    rows = [(k, f"the very same line everywhere\nown line of document {k}") for k in range(1500)]
    found = L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in found) == 1499 and {r["text"] for r in found if r["doc_id"]} == {f"own line of document {k}" for k in range(1, 1500)}


def by_words(rows, lines=4, sentences=8):
    """The words that stay of each document, in a way that shares nothing with units()."""
    places = []
    for doc, text in rows:
        for line in re.finditer(r"[^\n]+", text):
            runs = [[]]
            for word in re.finditer(r"\S+", line[0]):
                runs[-1].append((line.start() + word.start(), unicodedata.normalize("NFKC", word[0]).lower()))
                if word[0][-1] in ".!?":
                    runs.append([])
            runs = [r for r in runs if r]
            whole = [x for r in runs for x in r]
            if len(whole) >= lines:
                places.append((("line", " ".join(w for _, w in whole)), doc, line.start(), {k for k, _ in whole}))
            for run in runs:
                key = re.sub("[.!? ]+$", "", " ".join(w for _, w in run))
                if len(key.split()) >= sentences:
                    begin = line.start() if len(runs) == 1 else run[0][0]
                    places.append((("sentence", key), doc, begin, {k for k, _ in run}))
    first, gone = {}, {doc: set() for doc, _ in rows}
    for key, doc, begin, _ in places:
        first[key] = min(first.get(key, (doc, begin)), (doc, begin))
    for key, doc, begin, words in places:
        if first[key] != (doc, begin):
            gone[doc] |= words
    return {doc: [w[0] for w in re.finditer(r"\S+", text) if w.start() not in gone[doc]] for doc, text in rows}


def test_a_passage_is_found_as_a_line_and_within_lines(spark):
    longer = f"Before it. {PASSAGE}! After it."
    rows = [(1, f"{PASSAGE}\nend"), (2, f"{longer}\nnext"), (3, f"Start. {PASSAGE.title()}\nnext"), (4, f"x\n{PASSAGE} .\ny"), (5, f"x\n{PASSAGE}.")]
    found = {r["doc_id"]: r["text"] for r in L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: f"{PASSAGE}\nend", 2: "Before it. After it.\nnext", 3: "Start.\nnext", 4: "x\ny", 5: "x\n"}


def test_layouts_equal_brute_force_by_words(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choices("ab cd ef gh ij kl mn Op qr ｓｔ ü".split(), k=k)) for k in (3, 4, 7, 8, 9, 12, 60) for _ in range(5)]
    rows = []
    for doc in range(60):
        parts = [rng.choice(pool) + rng.choice(["", ".", "!", "?!", " ."]) + rng.choice([" ", "\n", "\n\n", " \n"]) for _ in range(rng.randrange(8))]
        rows.append((doc, "".join(parts)))
    found = {r["doc_id"]: r["text"].split() for r in L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == by_words(rows)
