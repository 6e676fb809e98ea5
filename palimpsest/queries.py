"""The driver's queries for the reference's operators, each with the same result in DuckDB's SQL where that can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import views
from palimpsest.functions import dictionaries, predicates, strategies
from palimpsest.functions.predicates import NEED_CONTEXT, NEED_CONTEXT_AS_DIGITS, column_hints, default_patterns
from palimpsest.functions.prf import seed_key
from palimpsest.operators import mask as masking
from palimpsest.operators import profile, seedmap, validate
from palimpsest.operators.validate import TableMeta
from palimpsest.plans import decide, history
from palimpsest.sources import catalog
from palimpsest.sql import DUCK

SEED = "palimpsest"
KEY = seed_key(SEED)
TEXT_COLUMNS = ["customer_ref", "full_name", "email", "phone", "ssn", "card_number", "zip_code", "ip_address", "guid", "city", "street", "website", "dob_text", "status"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_people(sql: str) -> str:
    return f"WITH people AS ({views.PEOPLE}) {sql}"


def cells(columns: list[str], source: str = "people") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)


# Detection


def detect(pattern: predicates.Pattern):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = profile.unpivoted(views.people(spark, sf_dir), TEXT_COLUMNS)
        found = profile.evidence(values, dict.fromkeys(TEXT_COLUMNS, "string"), [pattern])
        return found.where("hits > 0").select("column_name", "hits", "total", "ratio")

    v = predicates.strip(DUCK, "value")
    sql = with_people(
        f"""SELECT column_name, count(*) FILTER (hit) AS hits, count(*) AS total, count(*) FILTER (hit) / count(*) AS ratio
        FROM (SELECT column_name, {pattern.test(DUCK, 'v')} AS hit FROM (SELECT column_name, {v} AS v FROM ({cells(TEXT_COLUMNS)})) WHERE v <> '') GROUP BY column_name HAVING hits > 0"""
    )
    return query, sql


for _pattern in default_patterns():
    add(f"detect_{_pattern.name}", *detect(_pattern))


def evidence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = profile.sample_values(views.people(spark, sf_dir), TEXT_COLUMNS)
    found = profile.evidence(samples, dict.fromkeys(TEXT_COLUMNS, "string"), min_samples=3)
    return found.select("column_name", "name", "hits", "total", "ratio", "eligible", F.array_join("reasons", "; ").alias("reasons"))


def evidence_sql() -> str:
    parts = []
    for p in default_patterns():
        bare = "TRUE" if p.name in NEED_CONTEXT else "FALSE"
        if p.name in NEED_CONTEXT_AS_DIGITS:
            bare = r"coalesce(bool_or(hit AND regexp_matches(v, '^[0-9]+$')), FALSE)"
        if p.name == "ssn":
            bare = f"({bare} OR coalesce(bool_or(hit AND regexp_matches(v, '[Xx*]')), FALSE))"
        parts.append(f"SELECT column_name, '{p.name}' AS name, count(*) FILTER (hit) AS hits, count(*) AS total, {bare} AS context FROM (SELECT column_name, v, {p.test(DUCK, 'v')} AS hit FROM clean) GROUP BY column_name")
    hints = ", ".join(f"('{c}', {DUCK.array([DUCK.text(h) for h in sorted(column_hints(c))])}::VARCHAR[])" for c in TEXT_COLUMNS)
    return with_people(
        f""", clean AS (
      SELECT column_name, {predicates.strip(DUCK, 'value')} AS v FROM (
        SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY sha256(value), value) AS r FROM (SELECT DISTINCT * FROM ({cells(TEXT_COLUMNS)}))
      ) WHERE r <= 100 AND {predicates.strip(DUCK, 'value')} <> ''
    ), hints(column_name, hints) AS (VALUES {hints}
    ), tested AS ({" UNION ALL ".join(parts)}
    ), judged AS (
      SELECT column_name, name, hits, total, hits / total AS ratio, hints,
        list_filter([CASE WHEN hits / total < 0.9 THEN 'below threshold' END, CASE WHEN len(hints) > 0 AND hints <> [name] THEN 'column or type context conflicts' END,
          CASE WHEN context AND NOT list_contains(hints, name) THEN 'needs column or type context' END], lambda x: x IS NOT NULL) AS reasons
      FROM tested JOIN hints USING (column_name) WHERE hits > 0 OR list_contains(hints, name)
    ), evidence AS (
      SELECT column_name, name, hits, total, ratio, total >= 3 AND len(reasons) = 0 AND len(hints) <= 1 AS eligible, array_to_string(reasons, '; ') AS reasons FROM judged
    ) """.replace("WITH people AS", "", 1)
    )


_EVIDENCE = evidence_sql()
add("detect_evidence_all", evidence_all, _EVIDENCE + "SELECT * FROM evidence")


def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = dict.fromkeys(TEXT_COLUMNS, "string")
    found = profile.evidence(profile.sample_values(views.people(spark, sf_dir), TEXT_COLUMNS), types, min_samples=3)
    return profile.winners(found, types, min_samples=3)


add(
    "detect_winner",
    winner,
    _EVIDENCE
    + """SELECT h.column_name, CASE WHEN count(*) FILTER (eligible) = 1 THEN max(CASE WHEN eligible THEN name END) END AS kind,
    CASE WHEN count(*) FILTER (eligible) = 1 THEN 'match' WHEN count(*) FILTER (eligible) > 1 THEN 'several eligible' WHEN any_value(len(hints)) > 1 THEN 'conflicting context'
      WHEN coalesce(max(total), 0) < 3 THEN 'too few samples' ELSE 'inconclusive' END AS outcome,
    count(*) FILTER (eligible) AS n_eligible
    FROM hints h LEFT JOIN evidence e ON h.column_name = e.column_name GROUP BY h.column_name""",
)


def sample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = profile.sample_values(table(spark, sf_dir, "pages"), ["url"])
    return urls.unionByName(profile.sample_values(table(spark, sf_dir, "events"), ["event_type"]))


def _sampled(source: str, column: str) -> str:
    return f"SELECT '{column}' AS column_name, v AS value FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM {source} WHERE {column} IS NOT NULL) ORDER BY sha256(v), v LIMIT 100"


add("sample_distinct", sample_distinct, f"SELECT * FROM ({_sampled('pages', 'url')}) UNION ALL SELECT * FROM ({_sampled('events', 'event_type')})")


# Masking


def mask_query(strategy: str, column: str, key: str = "id", source: str = "people", kind: str = "string", markers: tuple[str, ...] = ()):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = views.people(spark, sf_dir) if source == "people" else table(spark, sf_dir, source)
        plan = masking.ColumnPlan(column, strategy, null_markers=markers)
        return masking.mask(df.select(key, column), [plan], SEED).withColumnRenamed(column, "masked")

    made = strategies.typed_sql(DUCK, strategies.get_strategy(strategy), column, kind, KEY)
    if markers:
        made = f"CASE WHEN NOT {predicates.marker(DUCK, column, list(markers))} THEN {made} END"
    sql = f"SELECT {key}, {made} AS masked FROM {source}"
    return query, with_people(sql) if source == "people" else sql


for _strategy, _column in {
    "null": "email",
    "blank": "phone",
    "redact": "street",
    "format_random": "customer_ref",
    "shuffle": "guid",
    "fake_first_name": "full_name",
    "fake_last_name": "full_name",
    "fake_name": "full_name",
    "fake_city": "city",
    "fake_email": "email",
    "fake_email_keep_domain": "email",
    "fake_ip": "ip_address",
    "fake_uuid": "guid",
    "fake_phone": "phone",
    "fake_ssn": "ssn",
    "fake_credit_card": "card_number",
}.items():
    add(f"mask_{_strategy}", *mask_query(_strategy, _column))
add("mask_fake_date", *mask_query("fake_date", "dob_text", markers=("N/A",)))
add("mask_null_placeholders", *mask_query("redact", "dob_text", markers=("N/A", "-")))
add("mask_date_typed", *mask_query("fake_date", "birth_date", kind="date"))
add("mask_timestamp_typed", *mask_query("fake_date", "o_orderdate", key="o_orderkey", source="orders", kind="timestamp_ntz"))
add("mask_numeric_int", *mask_query("format_random", "p_size", key="p_partkey", source="part", kind="int"))
add("mask_numeric_decimal", *mask_query("format_random", "credit_limit", kind="decimal(12,2)"))
add("mask_shuffle_part_names", *mask_query("shuffle", "p_name", key="p_partkey", source="part"))
add("mask_redact_documents", *mask_query("redact", "text", key="doc_id", source="documents"))
add("mask_blank_documents", *mask_query("blank", "text", key="doc_id", source="documents"))


# Seed map

SALT = "pepper"


def seedmap_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.people(spark, sf_dir).select("id", seedmap.value_hash(SALT, "fake_email", F.col("email")).alias("value_hash"))


add("seedmap_fingerprint", seedmap_fingerprint, with_people(f"SELECT id, sha256('{SALT}|fake_email|' || email) AS value_hash FROM people"))


def half_map(spark: SparkSession, sf_dir: str) -> seedmap.SeedMap:
    """A seed map with pairs for the customers with even keys, in a folder of its own that all executors share."""
    at = f"{shared_folder(spark)}/seeds-{uuid.uuid4().hex}"
    pairs = seedmap.SeedMap(spark, at, SALT)
    even = views.people(spark, sf_dir).where("id % 2 = 0")
    pairs.record(even.select(F.col("email").alias("value"), F.concat(F.lit("stored"), "id").alias("masked_value")), "fake_email", "fake_email")
    return pairs


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


HALF_MAP_SQL = f"SELECT sha256('{SALT}|fake_email|' || email) AS value_hash, 'stored' || CAST(id AS VARCHAR) AS masked_value FROM people WHERE id % 2 = 0"


def seedmap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = views.people(spark, sf_dir).select("id", "email")
    made = strategies.masked(strategies.get_strategy("fake_email"), "email", "string", SEED)
    found = half_map(spark, sf_dir).lookup(people.select("*", made.alias("new")), "email", "fake_email")
    return found.select("id", F.coalesce("stored", "new").alias("masked"), F.col("stored").isNotNull().alias("hit"))


_EMAIL = strategies.text_sql(DUCK, strategies.get_strategy("fake_email"), "email", KEY)
add(
    "seedmap_lookup_hit_miss",
    seedmap_lookup,
    with_people(
        f"""SELECT id, coalesce(masked_value, new) AS masked, masked_value IS NOT NULL AS hit
    FROM (SELECT id, {_EMAIL} AS new, sha256('{SALT}|fake_email|' || email) AS value_hash FROM people)
    LEFT JOIN (SELECT value_hash, min(masked_value) AS masked_value FROM ({HALF_MAP_SQL}) GROUP BY value_hash) USING (value_hash)"""
    ),
)


def seedmap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = half_map(spark, sf_dir)
    made = strategies.masked(strategies.get_strategy("fake_email"), "email", "string", SEED)
    pairs.record(views.people(spark, sf_dir).select(F.col("email").alias("value"), made.alias("masked_value")), "fake_email", "fake_email")
    return pairs.pairs().select("value_hash", "masked_value")


add(
    "seedmap_merge",
    seedmap_merge,
    with_people(
        f""", stored AS (SELECT value_hash, min(masked_value) AS masked_value FROM ({HALF_MAP_SQL}) GROUP BY value_hash),
    new AS (SELECT DISTINCT sha256('{SALT}|fake_email|' || email) AS value_hash, {_EMAIL} AS masked_value FROM people)
    SELECT * FROM stored UNION ALL SELECT * FROM new WHERE value_hash NOT IN (SELECT value_hash FROM stored)"""
    ).replace(") , stored", "), stored"),
)


def seedmap_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table masked for good with the map: stored replacements first, and new ones stored."""
    pairs, at = half_map(spark, sf_dir), f"{shared_folder(spark)}/masked-{uuid.uuid4().hex}"
    masking.apply(views.people(spark, sf_dir).select("id", "email"), [masking.ColumnPlan("email", "fake_email")], ["id"], SEED, at, pairs=pairs)
    return spark.read.parquet(at).withColumnRenamed("email", "masked")


add(
    "seedmap_apply",
    seedmap_apply,
    with_people(
        f"""SELECT id, coalesce(masked_value, {_EMAIL}) AS masked FROM people
    LEFT JOIN (SELECT value_hash, min(masked_value) AS masked_value FROM ({HALF_MAP_SQL}) GROUP BY value_hash) ON value_hash = sha256('{SALT}|fake_email|' || email)"""
    ),
)


# Validation: people against a copy with some faults


def faulted(spark: SparkSession, sf_dir: str, every: int = 0, dropped: int = 0) -> DataFrame:
    """people with emails masked, but for every `every`-th row; without rows whose key is a multiple of `dropped`."""
    df = views.people(spark, sf_dir)
    made = strategies.masked(strategies.get_strategy("fake_email"), "email", "string", SEED)
    out = df.withColumn("email", F.when(F.col("id") % every == 0, F.col("email")).otherwise(made) if every else made)
    return out.where(F.col("id") % dropped != 0) if dropped else out


def faulted_sql(every: int = 0, dropped: int = 0) -> str:
    email = f"CASE WHEN id % {every} = 0 THEN email ELSE {_EMAIL} END" if every else _EMAIL
    return f"SELECT id, {email} AS email, status, dob_text FROM people" + (f" WHERE id % {dropped} <> 0" if dropped else "")


def aligned_query(columns: list[str], limit: int | None, **faults: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validate.completeness(views.people(spark, sf_dir), faulted(spark, sf_dir, **faults), ["id"], columns, limit)

    cut = f"ORDER BY id LIMIT {limit}" if limit is not None else ""
    parts = []
    for c in columns:
        real = f"s.{c} IS NOT NULL AND NOT {predicates.test_data(DUCK, f's.{c}')}"
        parts.append(
            f"""SELECT '{c}' AS column_name, count(s.id) AS source_rows, count(t.id) AS target_rows, count(*) FILTER (t.id IS NULL) AS source_only, count(*) FILTER (s.id IS NULL) AS target_only,
        count(*) FILTER (s.id IS NOT NULL AND t.id IS NOT NULL AND {real}) AS compared,
        count(*) FILTER (s.id IS NOT NULL AND t.id IS NOT NULL AND {real} AND s.{c} IS NOT DISTINCT FROM t.{c}) AS unmasked
        FROM (SELECT * FROM people {cut}) s FULL JOIN (SELECT * FROM ({faulted_sql(**faults)}) {cut}) t ON s.id = t.id"""
        )
    partial = f"((SELECT count(*) FROM people) > {limit} OR (SELECT count(*) FROM ({faulted_sql(**faults)})) > {limit})" if limit is not None else "FALSE"
    sql = f"""SELECT *, CASE WHEN unmasked > 0 THEN 'fail' WHEN source_only > 0 OR target_only > 0 THEN CASE WHEN {partial} THEN 'warning' ELSE 'fail' END
      WHEN compared = 0 THEN 'skipped' WHEN {partial} THEN 'warning' ELSE 'pass' END AS status FROM ({' UNION ALL '.join(parts)})"""
    return query, with_people(sql)


add("validate_pk_full", *aligned_query(["email", "status"], None, every=100))
add("validate_pk_clean", *aligned_query(["email"], None))
add("validate_pk_partial", *aligned_query(["email"], 500))
add("validate_key_mismatch", *aligned_query(["email"], None, dropped=50))
add("validate_test_data_ignored", *aligned_query(["dob_text", "email"], None))


def validate_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.counted(views.people(spark, sf_dir), faulted(spark, sf_dir, dropped=50))


add(
    "validate_row_count",
    validate_row_count,
    with_people("SELECT source_rows, target_rows, target_rows - source_rows AS difference, CASE WHEN source_rows = target_rows THEN 'pass' ELSE 'fail' END AS status FROM (SELECT count(*) AS source_rows, count(*) FILTER (id % 50 <> 0) AS target_rows FROM people)"),
)
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def validate_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that no customer is of, and market segments that aren't nations, as tables that one side lacks."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("table_name"))
    used = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey").cast("string")).otherwise(F.col("c_mktsegment")).alias("table_name"))
    return validate.unmatched(names, used.distinct())


add(
    "validate_presence",
    validate_presence,
    """WITH a AS (SELECT CAST(n_nationkey AS VARCHAR) AS table_name FROM nation),
    b AS (SELECT DISTINCT CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS table_name FROM customer WHERE c_custkey % 10 <> 0)
    SELECT table_name, 'source' AS side FROM a WHERE table_name NOT IN (SELECT table_name FROM b) UNION ALL SELECT table_name, 'target' FROM b WHERE table_name NOT IN (SELECT table_name FROM a)""",
)


def validate_failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.failing_rows(views.people(spark, sf_dir), faulted(spark, sf_dir, every=100), ["id"], "email")
    return found.select("place", "redacted", (F.length("row_ref") > 0).alias("referenced"))


add(
    "validate_failing_rows",
    validate_failing_rows,
    with_people(f"SELECT (SELECT count(*) FROM people q WHERE q.id <= p.id) AS place, repeat('*', length(email)) AS redacted, TRUE AS referenced FROM people p WHERE id % 100 = 0 AND NOT {predicates.test_data(DUCK, 'email')} ORDER BY id LIMIT 5"),
)


def validate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    changed = lines.withColumn("l_quantity", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + 1000))
    return validate.overlap(lines, changed, "l_quantity")


add(
    "validate_overlap_keyless",
    validate_overlap,
    f"""WITH s AS (SELECT * FROM lineitem WHERE l_quantity IS NOT NULL AND NOT {predicates.test_data(DUCK, 'CAST(l_quantity AS VARCHAR)')}),
    c AS (SELECT * REPLACE (CASE WHEN l_orderkey % 10 = 0 THEN l_quantity ELSE l_quantity + 1000 END AS l_quantity) FROM lineitem),
    t AS (SELECT * FROM c WHERE l_quantity IS NOT NULL AND NOT {predicates.test_data(DUCK, 'CAST(l_quantity AS VARCHAR)')})
    SELECT v AS shared_values, r AS identical_rows, CASE WHEN v = 0 THEN 'pass' WHEN r > 0 THEN 'fail' ELSE 'warning' END AS status
    FROM (SELECT (SELECT count(*) FROM (SELECT l_quantity FROM s INTERSECT SELECT l_quantity FROM t)) AS v, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM t)) AS r)""",
)


def postcheck_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = views.people(spark, sf_dir).where("id % 50 <> 0")
    return validate.orphans(views.people_orders(spark, sf_dir), kept, "customer_id", "id").select("tenant_id", "order_id", "customer_id")


def with_orders(sql: str) -> str:
    return f"WITH people AS ({views.PEOPLE}), people_orders AS ({views.ORDERS}) {sql}"


add("postcheck_orphans", postcheck_orphans, with_orders("SELECT tenant_id, order_id, customer_id FROM people_orders WHERE customer_id NOT IN (SELECT id FROM people WHERE id % 50 <> 0)"))


def postcheck_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = strategies.get_strategy("fake_email")
    orders = views.people_orders(spark, sf_dir).withColumn("contact_email", strategies.masked(email, "contact_email", "string", SEED))
    apart = validate.disagreeing(orders, faulted(spark, sf_dir, every=100), ("customer_id", "id"), ("contact_email", "email"))
    return apart.groupBy(F.col("k").alias("customer_id")).agg(F.count("*").alias("n"))


add(
    "postcheck_cross_table_email",
    postcheck_cross_table,
    with_orders(
        f"""SELECT customer_id, count(*) AS n FROM (SELECT customer_id, {strategies.text_sql(DUCK, strategies.get_strategy('fake_email'), 'contact_email', KEY)} AS a FROM people_orders)
    JOIN ({faulted_sql(every=100)}) ON id = customer_id WHERE a IS DISTINCT FROM email GROUP BY customer_id"""
    ),
)
add(
    "postcheck_generated_total",
    lambda spark, sf_dir: views.people_orders(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(F.col("total") != F.col("quantity") * F.col("unit_price")).alias("wrong")),
    with_orders("SELECT count(*) AS rows, count(*) FILTER (total <> quantity * unit_price) AS wrong FROM people_orders"),
)


strategies.register_strategy("as_is", strategies.Strategy("as_is", mask=lambda d, v, key: v))  # for the gate to refuse


def mask_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = [masking.ColumnPlan("phone", "fake_phone"), masking.ColumnPlan("dob_text", "fake_date"), masking.ColumnPlan("status", "fake_ssn"), masking.ColumnPlan("CITY", "as_is"), masking.ColumnPlan("email", "fake_email")]
    return masking.gate(views.people(spark, sf_dir), plans, SEED)


def gate_sql() -> str:
    parts = []
    for column, strategy, invalid in (("phone", "fake_phone", "FALSE"), ("dob_text", "fake_date", "dob_text = 'N/A'"), ("status", "fake_ssn", "TRUE"), ("city", "as_is", "FALSE"), ("email", "fake_email", "FALSE")):
        made = strategies.text_sql(DUCK, strategies.get_strategy(strategy), column, KEY)
        parts.append(f"SELECT '{column}' AS column_name, count(*) AS rows, count(*) FILTER ({invalid}) AS invalid, count(*) FILTER (NOT {invalid} AND trim({column}) <> '' AND lower({column}) = lower({made})) AS unchanged FROM people")
    return " UNION ALL ".join(parts)


add("mask_gate", mask_gate, with_people(gate_sql()))


# Decisions, history and reports

_HISTORY = """SELECT concat('c', CAST(id % 200 AS STRING)) AS column_name, CASE id % 3 WHEN 0 THEN 'keep' ELSE 'mask' END AS decision,
  CASE WHEN id % 7 < 2 THEN 'approved' ELSE 'pending' END AS review_status, CASE WHEN id % 5 = 0 THEN 'bigint' ELSE 'string' END AS data_type,
  CAST(id % 11 AS INT) AS revision, id AS seq FROM people"""
_COLUMNS = "SELECT concat('c', CAST(id AS STRING)) AS column_name, CASE WHEN id % 9 = 0 THEN 'BIGINT' ELSE 'string' END AS data_type FROM people WHERE id <= 220"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some records for each of 200 columns, made from the customers."""
    return spark.sql(_HISTORY.replace("FROM people", "FROM {people}"), people=views.people(spark, sf_dir))


add(
    "history_reuse",
    lambda spark, sf_dir: history.reuse(spark.sql(_COLUMNS.replace("FROM people", "FROM {people}"), people=views.people(spark, sf_dir)), _history(spark, sf_dir)),
    with_people(
        f"""SELECT c.column_name, CASE WHEN h.column_name IS NULL THEN 'none' WHEN h.data_type <> lower(c.data_type) THEN 'pending' ELSE 'reuse' END AS outcome, CASE WHEN h.data_type = lower(c.data_type) THEN h.decision END AS decision
    FROM ({_COLUMNS}) c LEFT JOIN (SELECT * FROM ({_HISTORY}) WHERE review_status = 'approved' QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY seq DESC) = 1) h USING (column_name)"""
    ),
)
add(
    "history_latest",
    lambda spark, sf_dir: history.latest(_history(spark, sf_dir)).select("column_name", "decision", "review_status", "revision"),
    with_people(f"SELECT column_name, decision, review_status, revision FROM ({_HISTORY}) QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY CASE review_status WHEN 'approved' THEN 1 ELSE 0 END DESC, seq DESC) = 1"),
)


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each customer's reference by its key, of which those with keys divisible by 3 are selected."""
    kind = F.when(F.col("id") % 7 == 0, "error").when(F.col("id") % 5 == 0, "unknown").when(F.col("id") % 2 == 0, "not_sensitive").otherwise("sensitive")
    source = F.when(F.col("id") % 11 == 0, "history_pending").otherwise("pattern")
    people = views.people(spark, sf_dir)
    decisions = people.select(F.col("customer_ref").alias("column_name"), kind.alias("sensitivity"), source.alias("source"))
    return validate.coverage(decisions, people.where("id % 3 = 0").select(F.col("customer_ref").alias("column_name")))


add(
    "coverage_report",
    coverage_report,
    with_people(
        """SELECT customer_ref AS column_name, CASE WHEN id % 7 = 0 THEN 'error' WHEN id % 5 = 0 AND id % 11 = 0 THEN 'warning' WHEN id % 3 = 0 THEN 'pass'
    WHEN id % 5 <> 0 AND id % 2 = 0 THEN 'pass' ELSE 'warning' END AS status FROM people"""
    ),
)


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the statuses that the aligned check gives to some copies."""
    found = [aligned_query(["email", "status"], None, every=100)[0], aligned_query(["email"], 500)[0], aligned_query(["email"], None)[0]]
    statuses = [q(spark, sf_dir).select("status") for q in found]
    return validate.summary(statuses[0].unionByName(statuses[1]).unionByName(statuses[2]))


add("validation_summary", validation_summary, "SELECT 1 AS n_pass, 2 AS n_fail, 1 AS n_warning, 0 AS n_skipped, 0 AS n_error, FALSE AS passed, FALSE AS passed_strict")


def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.scan(catalog.Catalog(spark, sf_dir)).decisions()


add("scan_tables", scan_tables)
add(
    "schema_elements",
    lambda spark, sf_dir: catalog.Catalog(spark, sf_dir).elements().where(F.col("table_name").isin(TABLES)).select("table_name", "column_name", "is_key", "is_generated"),
    f"SELECT table_name, column_name, FALSE AS is_key, FALSE AS is_generated FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})",
)
add("table_fingerprint", lambda spark, sf_dir: masking.fingerprint(views.people(spark, sf_dir)))
add(
    "table_version_fingerprint",
    lambda spark, sf_dir: masking.version_fingerprint(views.people(spark, sf_dir).select("id", "email", "phone"), ["id"], 1000),
    with_people(
        """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(CAST(place AS VARCHAR) || ':' || sha256('{"id":' || id || ',"email":"' || email || '","phone":' || coalesce('"' || phone || '"', 'null') || '}')), 1, 15) AS BIGINT)) AS VARCHAR) AS digest
    FROM (SELECT *, row_number() OVER (ORDER BY id) AS place FROM people) WHERE place <= 1000"""
    ),
)
add(
    "table_row_counts",
    lambda spark, sf_dir: catalog.Catalog(spark, sf_dir).row_counts(TABLES),
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES),
)


# Sources, plans and custom parts


def _customers(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    return catalog.Catalog(spark, sf_dir, {"customer": TableMeta(keys=["c_custkey"]), "lineitem": TableMeta(keys=["l_orderkey", "l_linenumber"])})


add(
    "source_page",
    lambda spark, sf_dir: _customers(spark, sf_dir).page("customer", 100, after=(50,), columns=["c_custkey", "c_name"]),
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 100",
)
add(
    "source_page_composite",
    lambda spark, sf_dir: _customers(spark, sf_dir).page("lineitem", 50, after=(7, 2), columns=["l_orderkey", "l_linenumber"]).distinct(),
    "SELECT DISTINCT * FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 7 OR l_orderkey = 7 AND l_linenumber > 2 ORDER BY l_orderkey, l_linenumber LIMIT 50)",
)
add("source_distinct_values", lambda spark, sf_dir: _customers(spark, sf_dir).distinct_values("orders", "o_orderpriority"), "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL LIMIT 5000")
add("source_rows", lambda spark, sf_dir: _customers(spark, sf_dir).rows("nation", ["n_nationkey", "n_name"]), "SELECT n_nationkey, n_name FROM nation")


def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return spark.createDataFrame([(t, c.key_holds(t)) for t in ("customer", "lineitem", "orders")], "table_name string, holds boolean")


add(
    "source_keys",
    source_keys,
    """SELECT 'customer' AS table_name, (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) AS holds
    UNION ALL SELECT 'lineitem', (SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) UNION ALL SELECT 'orders', FALSE""",
)


def seedmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = half_map(spark, sf_dir)
    return pairs.all_pairs(10**6).agg(F.count("*").alias("listed"), F.count_distinct("value_hash").alias("hashes")).withColumn("counted", F.lit(pairs.count()))


add("seedmap_count", seedmap_count, with_people("SELECT count(DISTINCT email) AS listed, count(DISTINCT email) AS hashes, count(DISTINCT email) AS counted FROM people WHERE id % 2 = 0"))
_APPLIED = [masking.ColumnPlan("EMAIL", "fake_email"), masking.ColumnPlan("dob_text", "fake_date", null_markers=("N/A",)), masking.ColumnPlan("id", "format_random")]


def mask_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table masked for good; its key is planned, too, and stays."""
    at = f"{shared_folder(spark)}/masked-{uuid.uuid4().hex}"
    masking.apply(views.people(spark, sf_dir).select("id", "email", "dob_text", "status"), _APPLIED, ["id"], SEED, at)
    return spark.read.parquet(at)


_DATE = strategies.text_sql(DUCK, strategies.get_strategy("fake_date"), "dob_text", KEY)
add("mask_apply", mask_apply, with_people(f"SELECT id, {_EMAIL} AS email, CASE WHEN dob_text <> 'N/A' THEN {_DATE} END AS dob_text, status FROM people"))


def mask_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = masking.dry_run(views.people(spark, sf_dir).select("id", "email", "dob_text", "status"), _APPLIED, ["id"], SEED, preview=10)
    return spark.createDataFrame([(done.rows, ",".join(done.columns), ",".join(done.skipped_columns), len(done.preview))], "rows long, masked string, kept string, previewed int")


add("mask_dry_run", mask_dry_run, with_people("SELECT count(*) AS rows, 'email,dob_text' AS masked, 'id' AS kept, least(10, count(*)) AS previewed FROM people"))
add("mask_numeric_double", *mask_query("format_random", "c_nationkey_half", key="c_custkey", source="halves", kind="double"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 0.5).cast("double").alias("c_nationkey_half"))


QUERIES["mask_numeric_double"] = lambda spark, sf_dir: masking.mask(_halves(spark, sf_dir), [masking.ColumnPlan("c_nationkey_half", "format_random")], SEED).withColumnRenamed("c_nationkey_half", "masked")
ORACLE["mask_numeric_double"] = "WITH halves AS (SELECT c_custkey, CAST(c_nationkey + 0.5 AS DOUBLE) AS c_nationkey_half FROM customer) " + ORACLE["mask_numeric_double"]

dictionaries.register_dictionary("planets", ["Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune", " ", "Mars"])
strategies.register_strategy("fake_planet", strategies.from_dictionary("planets"))
add("mask_custom_dictionary", *mask_query("fake_planet", "city"))
strategies.register_strategy("reversed", lambda c: F.reverse(c))
add("mask_custom_strategy", lambda spark, sf_dir: masking.mask(views.people(spark, sf_dir).select("id", "guid"), [masking.ColumnPlan("guid", "reversed")], SEED).withColumnRenamed("guid", "masked"), with_people("SELECT id, reverse(guid) AS masked FROM people"))
add("detect_custom_pattern", *detect(predicates.Pattern("customer_ref", lambda d, v: d.matches(v, r"^C[0-9]{8}\z" if d.name == "spark" else r"^C[0-9]{8}$"))))


def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that lost a column and has another type of one, issue by issue."""
    people = views.people(spark, sf_dir)
    copy = people.drop("phone").withColumn("id", F.col("id").cast("string"))
    found = validate.schema_elements("people", people, copy, TableMeta(keys=["id"]), TableMeta(keys=["id"], unique=["email"]))
    return spark.createDataFrame([(i.message, i.status, len(i.detail["source_only"]), len(i.detail["target_only"])) for i in found], "element string, status string, source_only int, target_only int")


add(
    "validate_schema",
    validate_schema,
    "SELECT * FROM (VALUES ('columns', 'fail', 2, 1), ('primary_key', 'pass', 0, 0), ('indexes', 'pass', 0, 0), ('foreign_keys', 'pass', 0, 0), ('unique', 'fail', 0, 1), ('checks', 'pass', 0, 0)) t(element, status, source_only, target_only)",
)
