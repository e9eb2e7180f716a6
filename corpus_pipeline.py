"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``, whatever those are. Keys are unique; of rows that repeat
a key one stays after the exact copies are removed. A row without a key can't be
named by a stage that compares documents, and stays. Null texts count as empty,
very long ones are read whole, and an empty table stays empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Shelf, table
from strandloom.llm.decontaminate import find_leaks
from strandloom.llm.exactdedup import find_copies
from strandloom.llm.neardup import near_duplicates
from strandloom.llm.packing import VOCABULARY, pack
from strandloom.llm.quality import fit_quality, score_quality

#: Of near copies: words of a shingle, and the similarity in percent.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as any other; rows that repeat a text get one
    answer. Without labels of both classes nothing goes.
    """
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, net, score="__quality")
    return scored.where(F.col("__quality") >= 0.5).drop("__quality")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest key stays."""
    shelf = Shelf(spark)
    found = find_copies(docs.select("doc_id", "text"))
    kept = shelf.put(found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id"), "kept")
    return only(docs, kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest key stays."""
    found = near_duplicates(docs, words=WORDS, percent=PERCENT)
    return only(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and wordless texts hold none and stay. An empty benchmark drops nothing.
    """
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), prefix="__leak_")
    return found.where(F.size("__leak_hit_spans") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of tokens.

    Every row has its pieces, a null or empty text one of its end id alone.
    """
    return pack(docs, public_tokenizers.path(VOCABULARY))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept``, one row of a repeated key, and all rows without a key."""
    out = docs.join(kept.distinct(), "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    out = out if repeated.isEmpty() else out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id IS NULL"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the networks nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shelf.put(docs, f"{k}-{name}")
            shelf.keep(f"{k}-{name}")
    return docs
