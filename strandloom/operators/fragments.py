"""Consensus fragments of groups of sequences, for placement in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import iupac

from .counts import require_known


def consensus(aligned: DataFrame, group: str = "clean_name") -> DataFrame:
    """(group, sequence): each column's most frequent letter, gaps taken out.

    Ties go to a letter rather than a gap, then to the lowest code point.
    """
    cells = aligned.select(group, F.posexplode(iupac.letters("sequence")).alias("k", "letter"))
    votes = cells.groupBy(group, "k", "letter").agg(F.count("*").alias("n"))
    best = Window.partitionBy(group, "k").orderBy(F.col("n").desc(), F.col("letter") == "-", "letter")
    won = votes.withColumn("r", F.row_number().over(best)).where("r = 1")
    letters = F.array_sort(F.collect_list(F.struct("k", "letter")))
    joined = won.groupBy(group).agg(letters.alias("x"))
    return joined.select(group, F.replace(F.array_join("x.letter", ""), F.lit("-"), F.lit("")).alias("sequence"))


def approximate_start(sequence: str, primer: str) -> int | None:
    """Where a primer fits best without gaps; null if no letter agrees."""
    sets = [set(iupac.DEGENERATE.get(c, c)) for c in primer]
    best, at = 0, None
    for k in range(len(sequence) - len(primer) + 1):
        score = sum(bool(s & set(iupac.DEGENERATE.get(c, c))) for s, c in zip(sets, sequence[k:], strict=False))
        if score > best:
            best, at = score, k
    return at


def approximate_offsets(rows: DataFrame) -> DataFrame:
    """(sequence, primer) with fuzzy_start and fuzzy_end, for the few that have no exact match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start = [approximate_start(s, p) for s, p in zip(b["sequence"], b["primer"], strict=True)]
            end = [None if a is None else a + len(p) for a, p in zip(start, b["primer"], strict=True)]
            yield b.assign(fuzzy_start=pd.array(start, dtype="Int64"), fuzzy_end=pd.array(end, dtype="Int64"))

    return rows.select("sequence", "primer").mapInPandas(run, "sequence string, primer string, fuzzy_start long, fuzzy_end long")


def primer_ends(rows: DataFrame, sequence: str, primer: str, out: str) -> DataFrame:
    """Add the offset behind each row's primer: exact if it matches, else the best fit."""
    exact = iupac.find_end(F.col(sequence), iupac.primer_pattern(primer))
    rows = rows.withColumn(out, exact)
    wanted = rows.where(F.col(out).isNull()).select(F.col(sequence).alias("sequence"), F.col(primer).alias("primer")).distinct()
    fuzzy = approximate_offsets(wanted).select(F.col("sequence").alias(sequence), F.col("primer").alias(primer), "fuzzy_end")
    return rows.join(fuzzy, [sequence, primer], "left").withColumn(out, F.coalesce(out, F.col("fuzzy_end").cast("int"))).drop("fuzzy_end")


def reconstruct_fragment_rep_seqs(reconstruction_map: DataFrame, reconstruction_summary: DataFrame, aligned_sequences: DataFrame) -> DataFrame:
    """(id, sequence) of every clean name of several members.

    The fragment lies between the end of the first forward primer and the last
    forward primer's end plus the last kmer's length. If every feature has one
    member there is nothing to resolve, and one row ('1', 'ATCG') says so.
    """
    spark = reconstruction_map.sparkSession
    several = reconstruction_summary.select(F.col("feature_id").alias("clean_name")).where(F.size(iupac.split_ids("clean_name")) > 1)
    if several.isEmpty():
        return spark.createDataFrame([("1", "ATCG")], "id string, sequence string")
    rows = reconstruction_map.join(several, "clean_name", "left_semi")
    known = aligned_sequences.select(F.col("id").alias("db_seq"), "sequence")
    require_known(rows, known, "db_seq", "the alignment")
    merged = consensus(rows.select("db_seq", "clean_name").join(known, "db_seq"))
    ends = rows.groupBy("clean_name").agg(
        F.min(F.struct("first_region", "db_seq", "first_fwd_primer"))["first_fwd_primer"].alias("first_primer"),
        F.max(F.struct("last_region", "db_seq", "last_fwd_primer", "last_kmer_length")).alias("last"),
    )
    placed = merged.join(ends, "clean_name").select("clean_name", "sequence", "first_primer", F.col("last.last_fwd_primer").alias("last_primer"), F.col("last.last_kmer_length").alias("n"))
    placed = primer_ends(primer_ends(placed, "sequence", "first_primer", "begin"), "sequence", "last_primer", "anchor")
    begin, end = F.coalesce("begin", F.lit(0)), F.coalesce("anchor", F.lit(0)) + F.col("n")
    return placed.select(F.col("clean_name").alias("id"), F.substring("sequence", begin + 1, F.greatest(end - begin, F.lit(0))).alias("sequence"))
