"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

1. language: documents without a letter, or of which no language is likelier than all others together, go.
2. near_duplicates: of each component of linked documents the one with the least doc_id stays.
3. decontamination: documents go that have a run of 13 or more words in benchmark windows, which is a whole window of any
   item that isn't shorter, or of which a twentieth or more of the words lies in windows, as may be by short items.
4. secrets: every secret in a text is replaced by a mark; all documents stay.
5. packing: what is left is packed into sequences of at most 4096 tokens; a row for each piece.

Defined cases. Null and empty texts have no letter and go in stage 1; by themselves, the other stages keep them, and the
last gives each a piece of the end token alone. Very long texts are read whole, in parts. Ties: of equally likely
languages neither is likelier than all others, so the document goes; of linked documents with one doc_id any one with
its text stays; equally good bins go to the fullest. Repeated rows are linked, so one stays. Null ids are values like any
other, and are never a reason to go. Empty tables give no rows in any stage; without any labelled row stage 1 keeps
nothing, as no language is known. Other columns are carried along by stages 1 to 4, whatever their names; n_chars, if
there is one, follows the text in stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard, langid, packing, secrets
from palimpsest.llm.common import cut, table
from palimpsest.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs), min_score=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least_run=13)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.col("text")
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: Neither the fitted classifier of the first stage nor the tokenizer of the last can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
