import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing as P
from palimpsest.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check(rows, texts, tokenizer, capacity):
    ids = {}
    for doc, text in texts:
        ids.setdefault(doc, tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    at = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r["start"] == r["piece"] * capacity
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[d]) for d, _ in texts)
    for parts in at.values():
        reached = 0
        for offset, length in sorted(parts):
            assert offset == reached
            reached += length
        assert reached <= capacity
    return len(at)


@pytest.mark.parametrize("capacity,group", [(4096, 8192), (64, 5), (16, 3)])
def test_places_are_gapless_and_ids_right(docs, path, tokenizer, capacity, group):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = P.pack(docs, path, capacity=capacity, group_rows=group).collect()
    check(rows, texts, tokenizer, capacity)


def test_empty(empty, path):
    assert P.pack(empty, path).count() == 0


def test_few_sequences(spark, sf, path, tokenizer):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = P.pack(df, path, capacity=512, group_rows=100).collect()
    used = check(rows, [tuple(r) for r in df.collect()], tokenizer, 512)
    assert used <= 1.03 * sum(r["length"] for r in rows) / 512 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcXYZé'sst 1 2İſß.,<|endoftext|>́ \n")), max_size=40))
def test_chunks_give_the_tokenizers_ids(text):
    encoder = P.encoder(tokenizer_path())
    expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == expected


def test_sum_of_squares_rule():
    lengths = np.array([3, 7, 5, 5, 2, 8, 10])
    bins, offsets, levels = P.sum_of_squares(lengths, 10)
    assert bins[0] == bins[1] and levels == [10, 10, 10, 10] and offsets.tolist() == [0, 3, 0, 5, 0, 2, 0]


def naive(lengths, capacity):
    """Each item where the sum over gaps of the squared number of open bins is least; of equals the fullest bin, then
    the one opened to that level last."""
    bins, touched = [], []
    for size in lengths:
        def total(levels):
            gaps = [capacity - x for x in levels if x < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [(total([*bins[:k], bins[k] + size, *bins[k + 1 :]]), -bins[k], -touched[k], k) for k in range(len(bins)) if bins[k] + size <= capacity]
        options.append((total([*bins, size]), 0, 0, len(bins)))
        k = min(options)[-1]
        if k == len(bins):
            bins.append(0)
            touched.append(0)
        yield k, bins[k]
        bins[k] += size
        touched[k] = max(touched) + 1


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_equals_a_naive_one(lengths):
    bins, offsets, _ = P.sum_of_squares(np.array(lengths, dtype=np.int64), 12)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == list(naive(lengths, 12))


def test_long_chunks_are_not_remembered(path):
    encoder = P.ChunkEncoder(path)
    encoder.ids(b"a" * 1000 + b" word")
    assert list(encoder) == [b"word"] and encoder.held > 0
