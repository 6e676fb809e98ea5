import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import tokencounts as T
from palimpsest.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def ranks():
    return tokenizer_path("byte_bpe_50k.tiktoken")


def test_sections_add_up(docs, empty, ranks):
    encoding = T.encoder(ranks, public_tokenizers.PATTERN).encoding
    found = T.count_tokens(docs, ranks, public_tokenizers.PATTERN).collect()
    for doc, text in {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}:
        mine = sorted((r["start"], r["end"], r["n_tokens"]) for r in found if r["doc_id"] == doc)
        copies = 2 if doc == 7 else 1
        assert sum(n for *_, n in mine) == copies * len(encoding.encode_ordinary(text or ""))
        assert "".join((text or "")[a:b] for a, b, _ in mine[::copies]) == (text or "")
    assert T.count_tokens(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_fields(docs, ranks):
    found = T.count_tokens(docs.where("doc_id = 5"), ranks, public_tokenizers.PATTERN, fields=("lang", "text")).collect()
    encoding = T.encoder(ranks, public_tokenizers.PATTERN).encoding
    whole = "en\n" + docs.where("doc_id = 5").first()["text"]
    assert [r["field"] for r in found] == ["lang", "text"] and sum(r["n_tokens"] for r in found) == len(encoding.encode_ordinary(whole))


@pytest.mark.parametrize("rule,expected", [("first", [2, 1, 0]), ("last", [1, 1, 1]), ("most", [1, 1, 1])])
def test_crossing_tokens_follow_the_rule(rule, expected):
    ends, bounds = np.array([2, 8, 12]), np.array([3, 9, 12])  # sections of 3, 6 and 3 bytes; tokens of 2, 6 and 4
    assert T.allocate(ends, bounds, rule)[0].tolist() == expected


def test_long_texts_have_the_same_tokens(ranks, monkeypatch):
    text = "Some words, numbers 123 and  spaces. " * 400
    encoder = T.encoder(ranks, public_tokenizers.PATTERN)
    whole = encoder.token_ends(text)
    monkeypatch.setattr(T, "PART", 500)
    assert np.array_equal(whole, encoder.token_ends(text))


@pytest.mark.parametrize("rule", T.RULES)
def test_attribution_byte_by_byte(spark, ranks, rule):
    """Sections against a loop over the bytes of each token, with text of several bytes a character."""
    texts = [(1, "one\n\n\ntwo three\n"), (2, "Ünï\n中文 text\nlast 漢字漢字\n\n"), (3, "\n\n\n\n"), (4, "no line feed"), (5, None), (6, ""), (7, "a\n" * 50 + "🙂🙂\n")]
    df = spark.createDataFrame([(k, t, f"Title {k}\n\n" if k % 2 else None) for k, t in texts], "doc_id long, text string, title string")
    found = T.count_tokens(df, ranks, public_tokenizers.PATTERN, fields=("title", "text"), rule=rule).collect()
    encoding, expected = T.encoder(ranks, public_tokenizers.PATTERN).encoding, []
    for r in df.collect():
        present = [(f, r[f]) for f in ("title", "text") if r[f]]
        owner, names = [], []  # of each byte its section
        for k, (field, value) in enumerate(present):
            at = 0
            for number, line in enumerate(value.splitlines(keepends=True)):
                names.append((field, number, at, at + len(line)))
                owner += [len(names) - 1] * len(line.encode())
                at += len(line)
            if k + 1 < len(present):
                owner.append(len(names) - 1)
        counts, crossing, at = [0] * len(names), [0] * len(names), 0
        for token in encoding.encode_ordinary("\n".join(v for _, v in present)):
            own = owner[at : at + len(encoding.decode_single_token_bytes(token))]
            at += len(own)
            best = max(set(own), key=lambda x: (own.count(x), -x))
            k = {"first": own[0], "last": own[-1], "most": best}[rule]
            counts[k] += 1
            crossing[k] += own[0] != own[-1]
        expected += [(r["doc_id"], *n, c, x) for n, c, x in zip(names, counts, crossing, strict=True)]
    assert sorted(map(tuple, found)) == sorted(expected) and any(x[-1] for x in expected)
