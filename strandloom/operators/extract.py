"""Regional kmers: expand, trim, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import iupac


def expand_degenerates(sequences: DataFrame, max_degenerates: int | None = None) -> DataFrame:
    """(db_seq, seq_name, sequence): one row for each reading of each sequence.

    A sequence without degenerate codes keeps its bare id; variants are sorted
    and named ``id@0001`` on. ``max_degenerates`` drops sequences with more codes
    than that, since readings multiply.
    """
    if max_degenerates is not None:
        sequences = cull_degenerates(sequences, max_degenerates)
    found = sequences.select(F.col("id").alias("db_seq"), iupac.variants("sequence").alias("v"))
    rows = found.select("db_seq", F.size("v").alias("n"), F.posexplode("v").alias("k", "sequence"))
    name = F.when(F.col("n") > 1, F.format_string("%s@%04d", F.col("db_seq"), F.col("k") + 1)).otherwise(F.col("db_seq"))
    return rows.select("db_seq", name.alias("seq_name"), "sequence")


def cull_degenerates(sequences: DataFrame, most: int) -> DataFrame:
    """Sequences with at most so many degenerate codes."""
    return sequences.where(iupac.count_degenerates("sequence") <= most)


def trimmed(sequence: Column, length: int) -> Column:
    """A prefix of ``length``; if that is negative a suffix, if 0 the whole."""
    if length > 0:
        return F.substring(sequence, 1, length)
    return F.right(sequence, F.lit(-length)) if length else sequence


def trim_sequences(named: DataFrame, length: int) -> DataFrame:
    """(db_seq, seq_name, amplicon): long enough ones, the first variant of equal amplicons."""
    kept = named.where(F.length("sequence") >= abs(length)).withColumn("amplicon", trimmed(F.col("sequence"), length))
    return kept.groupBy("db_seq", "amplicon").agg(F.min("seq_name").alias("seq_name")).select("db_seq", "seq_name", "amplicon")


def collapse(amplicons: DataFrame) -> DataFrame:
    """(kmer, amplicon, members): ids that share an amplicon, sorted over the whole table."""
    grouped = amplicons.groupBy("amplicon").agg(F.array_sort(F.collect_list("seq_name")).alias("members"))
    return grouped.select(F.array_join("members", "|").alias("kmer"), "amplicon", "members")


def prepare_extracted_region(
    sequences: DataFrame,
    region: str,
    trim_length: int,
    fwd_primer: str,
    rev_primer: str,
    reverse_complement_rev: bool = True,
    reverse_complement_result: bool = False,
    max_degenerates: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Collapsed kmers (id, sequence), and the kmer map of one region.

    Degenerate codes are expanded over the whole sequence before it is trimmed.
    ``reverse_complement_result`` turns the kmers' sequences, not their ids. The
    map's kmer_length is the signed trim length.
    """
    grouped = collapse(trim_sequences(expand_degenerates(sequences, max_degenerates), trim_length))
    out = iupac.reverse_complement("amplicon") if reverse_complement_result else F.col("amplicon")
    kmers = grouped.select(F.col("kmer").alias("id"), out.alias("sequence"))
    rev = iupac.reverse_complement_text(rev_primer) if reverse_complement_rev else rev_primer
    names = grouped.select("kmer", F.explode("members").alias("seq_name"))
    kmer_map = names.select(
        iupac.db_seq("seq_name").alias("db_seq"),
        "seq_name",
        "kmer",
        F.lit(region).alias("region"),
        F.lit(fwd_primer).alias("fwd_primer"),
        F.lit(rev).alias("rev_primer"),
        F.lit(trim_length).alias("kmer_length"),
    )
    return kmers, kmer_map
