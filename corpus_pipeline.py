"""Corpus preparation: language ID, quality rules, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. The first
three return the columns of their input for the rows they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm import host_rules, lang_id, ngram_join, packing
from mandisight.llm.common import fresh_path, ship


def _row(docs: DataFrame):
    """The whole row as one column, so that no column of the documents can clash with one of a stage."""
    return F.struct(*docs.columns).alias("_row")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Texts without a letter go, and predictions that score below almost all
    right ones of the calibration rows (``lang_id.floor_of``).

    Null and empty texts have no letter; whole texts are judged; equal rows are judged alike; extra columns are
    carried on. Without a usable ``lang`` there is no model and every document stays; with one language every text
    with a letter stays; an empty table stays empty.
    """
    ship(spark)
    model = lang_id.train(docs.where(~lang_id.held_out()).select("text", "lang"))
    if not model.languages:
        return docs
    judged = lang_id.predict(docs.select(_row(docs), "text"), model)
    kept = (F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= model.floor)
    return judged.where(kept).select("_row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected.

    Null and empty texts have no words and go; whole texts are measured; a null ``source`` is no host and cannot be
    rejected; repeated rows count again for their host; extra columns are carried on; an empty table stays empty.
    """
    ship(spark)
    return host_rules.judge(docs.select(_row(docs), "text", "source"), keep_text=False).where("kept").select("_row.*")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every near-duplicate group, once; rows without a doc_id stay.
    Different texts of one doc_id are different documents.

    Null and empty texts, and texts without a word, are one text; texts of fewer than five words are near only to
    equal ones; of rows that repeat doc_id and text any one stays; extra columns are carried on; an empty table
    stays empty.
    """
    ship(spark)
    key = F.coalesce(ngram_join.word_key(F.col("text")), F.lit(""))
    kept = ngram_join.keyed_join(docs.select("doc_id", "text")).where(
        F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("key", F.lit("")).alias("_key")).distinct()
    keyed = docs.where(F.col("doc_id").isNotNull()).select(_row(docs), "doc_id", key.alias("_key"))
    rows = keyed.join(kept, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    return rows.select("_row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences.

    Null and empty texts are one piece with the end id alone; long texts are cut into pieces; repeated rows are
    packed as rows of their own; extra columns are not read; an empty table gives no rows.
    """
    ship(spark)
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", keep_language),
    ("quality_rules", keep_quality),
    ("near_duplicates", keep_one_copy),
    ("packing", pack),
]

#: Trained and hashed stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
