"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard, langid, linededup, lm, media, packing, secrets, tokencounts, toxicity
from palimpsest.llm.common import crc_mod, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 1
    found = lm.score(docs, docs.where(~held_out), keep=(held_out.alias("held_out"),))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).drop("cid", "root")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, w[i : i + least(5, len(w)) - 1] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT r.doc_id, w.y FROM reached r JOIN ways w ON r.other = w.x
)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""

OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, w[i : i + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size, i, w[i : i + size - 1] AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
), found AS (
  SELECT d.doc_id, d.i, d.size, t.item_id FROM doc_windows d JOIN item_windows t ON d.size = t.size AND d.win = t.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def secrets_sql() -> str:
    """The rules' spans by RE2, which finds the same leftmost matches."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        pattern = ("(?s)(.*?)(" + secrets.java_pattern(r) + ")").replace("'", "''")
        value = 2 + r.group
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, regexp_extract_all(t, '{pattern}', 1) AS gaps, regexp_extract_all(t, '{pattern}', 2) AS wholes, regexp_extract_all(t, '{pattern}', {value}) AS vals FROM texts"
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join(parts)}
), each AS (
  SELECT doc_id, kind, rank, least, gaps, wholes, vals, unnest(range(1, len(wholes) + 1)) AS i FROM found WHERE len(wholes) > 0
), ends AS (
  SELECT doc_id, kind, rank, length(wholes[i]) AS size,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(wholes[1:i], lambda x: length(x))) AS BIGINT) AS stop
  FROM each WHERE length(vals[i]) >= least
), spans AS (
  SELECT doc_id, kind, rank, stop - size AS start, kind || ':' || CAST(stop - size AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS shown FROM ends
), grouped AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(shown, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN grouped USING (doc_id)
"""


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_media": op2_media,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "pipeline": pipeline,
}
ORACLE = {"op3_ngram_jaccard_join": OP3_SQL, "op5_secrets": secrets_sql(), "op8_decontaminate": OP8_SQL}
