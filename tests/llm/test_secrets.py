import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import secrets as S

MORE = "x token=abc secret: 'longvalue1' api_key=ABCDEF password = \"p4ssw0rd!\" token=token: abcdefgh ghp_" + "a" * 40 + " xoxb-1234567890-abc " + "f" * 30 + " ünï passwd=ééé passwd=sécrétwert PASSWORD:QWERTY12 AKIASHORT AKIA" + "Z9" * 10


def spans(text):
    out = []
    for k, rule in enumerate(S.RULES):
        for m in re.finditer(rule.pattern, text or "", re.IGNORECASE | re.ASCII if rule.any_case else 0):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_equals_plain_regexes(spark, docs, empty):
    extra = spark.createDataFrame([(20, MORE), (21, MORE), (21, MORE), (21, "other text"), (22, "-----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    found = sorted((str(r["doc_id"]), r["spans"]) for r in S.find_secrets(both).collect())
    assert found == sorted((str(r["doc_id"]), spans(r["text"])) for r in both.collect())
    assert sum(bool(x) for _, x in found) == 5
    assert S.find_secrets(empty).count() == 0


def test_redaction(spark, docs):
    out = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
    assert out[8] == "[SECRET] [SECRET] [SECRET]" and out[1] is None and out[2] == "" and out[10].startswith("Ünïcödé")
    assert S.redact(docs).columns == docs.columns and S.redact(docs).count() == docs.count()


def test_redaction_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "k", "h")], "doc_id long, text string, __key string, __text_hash string").selectExpr("*", "'r' AS row", "1 AS start", "2 AS end", "'i' AS id", "'x' AS h")
    out = S.redact(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "[SECRET]", "k", "h", "r", 1, 2, "i", "x")


def test_queries_of_patterns():
    assert S.trigram_query("[0-9a-f]+") == S.ANYTHING
    assert S.trigram_query("AKIA[A-Z0-9]+") == frozenset({frozenset({"aki", "kia"})})
    assert S.trigram_query("(abc|de)x+") == S.ANYTHING
    assert S.trigram_query("(abcd|efg)?hij") == frozenset({frozenset({"hij"})})


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_matches_meet_their_query(rule, data):
    """No match without the trigrams of a clause."""
    match = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True)).lower()
    assert any(all(t in match for t in clause) for clause in S.trigram_query(rule.pattern))
