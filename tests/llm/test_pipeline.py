import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm.common import cut
from palimpsest.llm.queries import tokenizer_path


def test_stages(spark, docs, sf):
    """Each stage takes effect on what its predecessor kept, and all but the last keep the columns."""
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, now, sf))
        if name != "packing":
            assert out.columns == docs.columns
            sizes.append(out.count())
        if name == "language":
            assert not {1, 2, 3, 4} & {r["doc_id"] for r in out.collect()}
        if name == "near_duplicates":
            assert {5} == {5, 6} & {r["doc_id"] for r in out.collect()} and [r["doc_id"] for r in out.collect()].count(7) == 1
        if name == "secrets":
            text = next(r for r in out.collect() if r["doc_id"] == 8)
            assert "hunter2" not in text["text"] and text["n_chars"] == len(text["text"])
        now = out
    assert {r["doc_id"] for r in now.collect()} == {5, 7, 8, 9, 10, None} and sizes == sorted(sizes, reverse=True)


def test_empty(spark, empty, sf):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, sf))
    assert now.count() == 0


def test_run_end_to_end(spark, tmp_path):
    """run() against each stage's rule, applied by hand to documents of which it is known what should happen to them."""
    rng = random.Random(3)
    vocabulary = {"en": [f"{a}{b}ing" for a in "bcdfgh" for b in "aeiou"], "de": [f"{a}{b}ung" for a in "klmnpr" for b in "äöüei"]}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    item = " ".join(f"question{k}" for k in range(20))
    rows, plain = [], {}
    for k in range(40):
        lang = "en" if k % 3 else "de"
        plain[k] = text(lang, rng.randint(40, 120))
        rows.append((k, plain[k], lang))
    gone = {100: None, 101: "12 34", 102: plain[4], 103: plain[4].upper(), 104: plain[7] + " more", 105: f"{plain[9]} {text('en', 300)} {item}"}
    rows += [(k, t, "en") for k, t in gone.items()]
    rows.append((200, text("en", 50) + " password=hunter2secret " + text("en", 50), "en"))
    df = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == {*plain, 200}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = {**plain, 200: next(t for k, t, _ in rows if k == 200).replace("password=hunter2secret", "[SECRET]")}
    for doc, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] == doc)
        assert pieces == [(0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in found)
    for (s, offset, length), (next_s, next_offset, _) in zip(places, places[1:], strict=False):
        assert next_offset == (offset + length if s == next_s else 0)


def test_clashing_columns_are_carried(spark, docs, sf):
    """The names that stages use inside are columns of documents here."""
    odd = docs.where("doc_id IN (5, 8)").selectExpr("*", "1 AS __text", "2 AS __cid", "3 AS __id", "4 AS __key", "5 AS text_hash", "6 AS clean", "7 AS h")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and {tuple(r)[-7:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}, name
