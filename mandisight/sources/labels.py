"""Interface labels (K6): a JSON object {language: {key: text}} read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(language, key, text), one row per label; of files that repeat a label the last in path order counts.

    A dictionary file holds an interface, so it is read whole, one row per file.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    by_language = files.select("file", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("language", "m"))
    rows = by_language.select("file", "language", F.explode("m").alias("key", "text"))
    return rows.groupBy("language", "key").agg(F.max_by("text", "file").alias("text"))
