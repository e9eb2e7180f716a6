"""FASTA as DataFrames of (id, sequence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, split at a ``>`` that begins a line by Spark's text source, so large files are read in parallel.

    The id is the header's first word; a sequence over several lines is joined. A
    ``>`` within a header belongs to it. Lines may end in CR LF; a record without
    sequence has an empty one.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return records.select(F.regexp_extract("value", r"^(\S*)", 1).alias("id"), body.alias("sequence"))


def write_fasta(sequences: DataFrame, path: str, single_file: bool = False) -> None:
    """Two lines a record, sorted by id; a range sort deals large tables over files."""
    rows = sequences.repartition(1).sortWithinPartitions("id") if single_file else sequences.orderBy("id")
    rows.select(F.concat(F.lit(">"), "id", F.lit("\n"), "sequence")).write.mode("overwrite").text(path)
