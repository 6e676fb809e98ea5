import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, predicates, strategies
from palimpsest.functions.dictionaries import register_dictionary
from palimpsest.functions.predicates import default_patterns
from palimpsest.sql import SPARK

TEXTS = {
    "fake_email": ["ada@north.test", "Grace@Stone.test"],
    "fake_email_keep_domain": ["ada@north.test", "x@y@z.test"],
    "fake_phone": ["202-555-0123", "(202) 555-0123", "+1 202.555.0123", "12025550123", "202-555-0123 ext 45"],
    "fake_ssn": ["123-45-6789", "123456789", "XXX-XX-1234"],
    "fake_credit_card": ["4111-1111-1111-1111", "378282246310005", "5555 5555 5555 4444", "6011111111111117", "4222222222222"],
    "fake_date": ["2001-02-28", "2/8/2001", "28-FEB-2001", "may 5, 2001", "31 December 9999", "0001-01-01", "20010228", "28.02.2001 10:30:00Z"],
    "fake_ip": ["10.0.0.1", "fe80::1AbC", "host-17"],
    "fake_uuid": ["123e4567-e89b-42d3-a456-426614174000", "{123E4567-E89B-42D3-A456-426614174000}"],
    "fake_name": ["Ada North", "x"],
    "fake_first_name": ["Ada"],
    "fake_last_name": ["North"],
    "fake_city": ["Chicago"],
    "format_random": ["Ab3-9z é", "7", "Q"],
    "shuffle": ["abc-123", "ab", "a1 b2"],
    "redact": ["Ab3-9z é 中"],
}


@pytest.fixture(scope="module")
def made(spark):
    out = {}
    for name, values in TEXTS.items():
        df = spark.createDataFrame([(v,) for v in values], "v string")
        s = strategies.get_strategy(name)
        columns = [strategies.masked(s, "v", "string", f"seed{k}").alias(f"m{k}") for k in range(4)]
        out[name] = [(r["v"], [r[f"m{k}"] for k in range(4)]) for r in df.select("v", *columns).collect()]
    return out


@pytest.mark.parametrize("name", TEXTS)
def test_changed_and_same_again(spark, made, name):
    for v, masked in made[name]:
        assert all(m is not None and m.lower() != v.lower() for m in masked), v
    if name != "redact":
        assert any(len(set(m)) > 1 for _, m in made[name])
    again = spark.createDataFrame([(v,) for v in TEXTS[name]], "v string").select(strategies.masked(strategies.get_strategy(name), "v", "string", "seed0"))
    assert [r[0] for r in again.collect()] == [m[0] for _, m in made[name]]


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", text)))


@pytest.mark.parametrize("name", ["fake_phone", "fake_ssn", "fake_credit_card"])
def test_layout_stays_and_kind_holds(spark, made, name):
    kind = next(p for p in default_patterns() if p.name == name.removeprefix("fake_"))
    everything = [(m,) for v, masked in made[name] for m in masked if len(m) == len(v)]
    assert len(everything) == 4 * len(TEXTS[name])
    assert all(re.sub(r"\d", "0", m) == re.sub(r"\d", "0", v) for v, masked in made[name] for m in masked)
    df = spark.createDataFrame(everything, "v string")
    assert df.where(~F.expr(kind.test(SPARK, "v"))).count() == 0


def test_shapes(made):
    assert all(shape(m[:6]) == shape(v[:6]) for v, masked in made["format_random"] for m in masked)
    assert all(sorted(m) == sorted(v) and re.sub(r"[^\W_]", "", m) == re.sub(r"[^\W_]", "", v) for v, masked in made["shuffle"] for m in masked)
    assert made["redact"][0][1][0] == "***-** * *"
    assert all(re.fullmatch(r"[a-z]+\.[a-z]+\d{1,3}@example\.invalid", m) for _, masked in made["fake_email"] for m in masked)
    assert [m.split("@", 1)[1] for m in made["fake_email_keep_domain"][1][1]] == ["y@z.test"] * 4
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", m) for m in made["fake_uuid"][0][1])
    assert all(m[0] == "{" and m[-1] == "}" and m == m.upper() for m in made["fake_uuid"][1][1])
    assert all(1 <= int(x) <= 254 for m in made["fake_ip"][0][1] for x in m.split("."))


def test_dates_keep_their_layout(spark, made):
    df = spark.createDataFrame([(v, m) for v, masked in made["fake_date"] for m in masked], "v string, m string")
    rows = df.select("v", "m", F.expr(dates.parsed(SPARK, "v")).alias("a"), F.expr(dates.parsed(SPARK, "m")).alias("b")).collect()
    for r in rows:
        assert r["b"] is not None and 30 <= abs((r["b"] - r["a"]).days) <= 730 and date.min <= r["b"] <= date.max
        assert re.sub(r"\d+", "0", re.sub("[A-Za-z]{3,}", "M", r["v"])) == re.sub(r"\d+", "0", re.sub("[A-Za-z]{3,}", "M", r["m"]))
    assert all(m == m.upper() for m in made["fake_date"][2][1]) and all(m == m.lower() for m in made["fake_date"][3][1])
    assert all(m.endswith(" 10:30:00Z") for m in made["fake_date"][-1][1])


def test_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",)], "v string")
    for name, s in strategies.STRATEGIES.items():
        if s.column is not None:
            continue
        found = [r[0] for r in df.select(strategies.masked(s, "v", "string", "x")).collect()]
        if name == "blank":
            assert found == ["", "", ""]
        elif name == "null":
            assert found == [None] * 3
        elif s.blank == "keep":
            assert found == [None, "", "  "], name
        else:
            assert found[0] is None and found[1].strip(), name


def test_values_that_cannot_be_replaced(spark):
    df = spark.createDataFrame([("12",), ("---",), ("aaaa",), ("20",), (None,)], "v string")
    for name, bad in (("fake_phone", 4), ("fake_ssn", 4), ("fake_credit_card", 4), ("fake_date", 4), ("format_random", 1), ("shuffle", 1)):
        s = strategies.get_strategy(name)
        assert df.where(~strategies.valid(s, "v", "string")).count() == bad, name


def test_types_stay(spark):
    df = spark.sql("SELECT 7 AS i, -120L AS l, CAST(10.50 AS DECIMAL(6,2)) AS d, DATE '2001-02-28' AS day, TIMESTAMP_NTZ '2001-02-28 10:30:00' AS t, 123456789 AS s, true AS b")
    for c, name in {"i": "format_random", "l": "format_random", "d": "format_random", "day": "fake_date", "t": "fake_date", "s": "fake_ssn"}.items():
        kind = dict(df.dtypes)[c]
        out = df.select(c, strategies.masked(strategies.get_strategy(name), c, kind, "x").alias("m"))
        row = out.first()
        assert dict(out.dtypes)["m"] == kind and row["m"] is not None and row["m"] != row[c], c
    assert out.first()["m"] >= 100_000_000
    assert not strategies.output_type_ok(strategies.get_strategy("blank"), "int") and not strategies.output_type_ok(strategies.get_strategy("redact"), "boolean")


def test_registry(spark):
    register_dictionary("colours", ["red", "green", " ", "red"])
    strategies.register_strategy("colour", strategies.from_dictionary("colours"))
    strategies.register_strategy("reversed", lambda c: F.reverse(c))
    df = spark.createDataFrame([("red",), ("other",)], "v string")
    assert [r[0] for r in df.select(strategies.masked(strategies.get_strategy("colour"), "v", "string", "x")).collect()][0] == "green"
    assert df.select(strategies.masked(strategies.get_strategy("reversed"), "v", "string", "x")).first()[0] == "der"
    with pytest.raises(KeyError):
        strategies.get_strategy("nothing")


def test_white_space_of_any_kind(spark):
    df = spark.createDataFrame([("  a b \n",)], "v string")
    assert df.select(F.expr(predicates.strip(SPARK, "v"))).first()[0] == "a b"
