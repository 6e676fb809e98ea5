"""Which values each kind accepts. All values of a kind are tested in one query."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import predicates
from palimpsest.functions.predicates import Pattern, column_hints, default_patterns
from palimpsest.operators import profile
from palimpsest.sql import SPARK

CASES = {
    "email": (["a@b.co", "first.last+tag@mail.example.org", "X_y@EXAMPLE.COM"], [".a@b.co", "a..b@c.de", "a.@b.co", "a@-b.co", "a@b", "see a@b.co", "a" * 65 + "@b.co", "a@b.co\n"]),
    "url": (["http://x.y", "HTTPS://example.test/a?b=1", "www.example.test"], ["example.test", "http://a b", "ftp://x"]),
    "ip_address": (["1.2.3.4", "255.255.255.255", "0.0.0.0"], ["1.2.3", "256.1.1.1", "01.2.3.4", "::1", "1.2.3.4.5"]),
    "uuid": (["123e4567-e89b-42d3-a456-426614174000", "123E4567-E89B-42D3-A456-426614174000"], ["123e4567e89b42d3a456426614174000", "123e4567-e89b-42d3-a456-42661417400g"]),
    "ssn": (["123-45-6789", "123 45 6789", "123456789", "XXX-XX-1234", "*****1234", "xxx xx 1234"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "123-45 6789", "XXX-XX-0000", "XxX-XX-1234"]),
    "credit_card": (["4111111111111111", "5555-5555-5555-4444", "378282246310005", "6011 1111 1111 1117", "2223003122003222"], ["4111111111111112", "0000000000000000", "411111111111111", "1234567812345670", "4111--1111-1111-1111"]),
    "zip_code": (["12345", "12345-6789"], ["1234", "12345-678", "123456"]),
    "phone": (["2025550123", "202-555-0123", "(202) 555-0123", "+1 202.555.0123", "1-202-555-0123", "202-555-0123 ext. 12", "202-555-0123x7"], ["555-0123", "102-555-0123", "202-155-0123", "202--555-0123", "(202 555-0123", "+44 20 7946 0958"]),
    "address": (["12 Oak Avenue", "7b Main St.", "1 Straße Ring Road", "9 Elm Ct apt 4"], ["Oak Avenue", "12 Oak", "12Avenue"]),
    "city": (["Chicago", "new york"], ["Atlantis", "Chicago, IL"]),
    "full_name": (["Ada North", "José O’Neil-Smith", "X", "J. R. R. Doe"], ["Ada 2", "--", "a b c d e f g", "a@b"]),
    "date": (["2001-02-28", "2001/2/8", "20010228", "02/28/2001", "2-28-2001", "28.02.2001", "28-Feb-2001", "28 February 2001", "February 28, 2001", "FEB 28 2001", "2001-02-28T23:59:59.123Z", "2001-02-28 1:00+05:30"], ["2001-02-30", "2001-13-01", "28/02/2001", "2001-02/28", "28-fEb-2001", "2001-02-28 24:00", "2001-02-28 10:60", "2001-02-28T10:00+25:00", "0000-01-01", "28-Feb 2001"]),
}


@pytest.fixture(scope="module")
def accepted(spark):
    rows = [(kind, v) for kind, (yes, no) in CASES.items() for v in [*yes, *no]]
    df = spark.createDataFrame(rows, "kind string, v string")
    tests = {p.name: F.expr(p.test(SPARK, "v")) for p in default_patterns()}
    return {(r["kind"], r["v"]) for k, t in tests.items() for r in df.where(F.col("kind") == k).where(t).collect()}


@pytest.mark.parametrize("kind", CASES)
def test_kind(accepted, kind):
    yes, no = CASES[kind]
    assert {v for k, v in accepted if k == kind} == set(yes), no


def test_order_of_days_and_months(spark):
    df = spark.createDataFrame([("28/02/2001",), ("02/28/2001",)], "v string")
    for order, expected in (("DMY", ["28/02/2001"]), ("MDY", ["02/28/2001"])):
        date = default_patterns(date_order=order)[-1]
        assert [r["v"] for r in df.where(F.expr(date.test(SPARK, "v"))).collect()] == expected


def test_placeholders(spark):
    values = ["", " ", "x", "aaaa", "----", "test", "N/A", "None", "aaaaaaaaaaa", "ab", "testing", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r["v"] for r in df.where(F.expr(predicates.test_data(SPARK, "v"))).collect()] == values[:8]


@pytest.mark.parametrize(
    "name,kind,expected",
    [
        ("email_address", "string", {"email"}),
        ("ipAddress", "string", {"ip_address"}),
        ("homePhone", "string", {"phone"}),
        ("hotel", "string", set()),
        ("candidate", "string", set()),
        ("FirstName", "string", {"full_name"}),
        ("shipping_street", "string", {"address"}),
        ("created", "timestamp_ntz", {"date"}),
        ("city_zip", "string", {"city", "zip_code"}),
    ],
)
def test_hints(name, kind, expected):
    assert column_hints(name, kind) == expected


def test_ratios_and_samples(spark):
    def winner(good, bad, name="contact", **options):
        values = [(name, f"u{k}@example.test") for k in range(good)] + [(name, f"bad{k} value") for k in range(bad)] + [(name, " ")] * 3
        found = profile.evidence(spark.createDataFrame(values, "column_name string, value string"), {name: "string"}, **options)
        return profile.winners(found, {name: "string"}).first()

    assert winner(90, 10)["kind"] == "email" and winner(899, 101)["kind"] is None
    assert winner(20, 0)["kind"] == "email" and winner(19, 0)["outcome"] in ("too few samples", "inconclusive")
    assert winner(50, 0, name="phone")["kind"] is None  # the name says otherwise
    with pytest.raises(ValueError):
        winner(1, 0, min_samples=0)


def test_own_patterns(spark):
    own = Pattern("badge", lambda d, v: d.matches(v, r"^B-[0-9]{4}\z"), 0.5)
    values = spark.createDataFrame([("code", f"B-{k:04}") for k in range(30)], "column_name string, value string")
    assert profile.evidence(values, {"code": "string"}, [own]).first()["eligible"]
    with pytest.raises(ValueError):
        Pattern("x", own.test, 0)


def test_samples_are_the_same_every_time(spark):
    df = spark.range(1000).selectExpr("CAST(id % 300 AS STRING) AS a", "id AS b", "array(id) AS c")
    first = sorted(profile.sample_values(df, limit=20).collect())
    assert first == sorted(profile.sample_values(df.repartition(7), limit=20).collect()) and len(first) == 40
