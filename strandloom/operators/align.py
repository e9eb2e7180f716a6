"""The bounded-mismatch join of kmers and read variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import iupac

#: Parts of a segment's kmers.
SALTS = 4


def check_read_lengths(sequences: DataFrame, what: str) -> tuple[int, int]:
    """(rows, their one length); ValueError if lengths differ."""
    n, low, high = sequences.agg(F.count("*"), F.min(F.length("sequence")), F.max(F.length("sequence"))).first()
    if low != high:
        raise ValueError(f"The {what} are not of a consistent length")
    return n, low or 0


def hamming_join(kmers: DataFrame, reads: DataFrame, length: int, max_mismatch: int) -> DataFrame:
    """(kmer, asv, mismatch) of all pairs that differ in at most so many places.

    Both sides are cut into ``max_mismatch + 1`` segments: two sequences within
    the bound agree in one at least, so an equi-join of segments finds every
    pair. A pair is taken at the first segment in which it agrees and nowhere
    else, which needs no further shuffle to make pairs distinct. If the bound
    reaches the length every pair is a result, and the join is the plain product.
    A segment that a large share of the kmers has (a conserved stretch) is dealt
    over ``SALTS`` tasks, its reads repeated for each.
    """
    a = kmers.select(F.col("id").alias("kmer"), F.col("sequence").alias("a"))
    b = reads.select(F.col("id").alias("asv"), F.col("sequence").alias("b"))
    if max_mismatch >= length:
        return a.crossJoin(b).select("kmer", "asv", iupac.hamming("a", "b").alias("mismatch"))
    cuts = [k * length // (max_mismatch + 1) for k in range(max_mismatch + 2)]

    def segments(of: str):
        return F.array(*(F.substring(of, lo + 1, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)))

    left = a.withColumn("sa", segments("a")).select("kmer", "a", "sa", F.posexplode("sa").alias("k", "segment"))
    right = b.withColumn("sb", segments("b")).select("asv", "b", "sb", F.posexplode("sb").alias("k", "segment"))
    earlier = F.exists(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)
    agreed = F.array_position(F.zip_with("sa", "sb", lambda x, y: x == y), F.lit(True)) - 1
    left = left.withColumn("salt", F.pmod(F.xxhash64("kmer"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = left.join(right, ["k", "segment", "salt"]).where(earlier & (agreed == F.col("k")))
    return pairs.withColumn("mismatch", iupac.hamming("a", "b")).where(F.col("mismatch") <= max_mismatch).select("kmer", "asv", "mismatch")


def align_regional_kmers(kmers: DataFrame, rep_seq: DataFrame, region: str, max_mismatch: int = 2) -> DataFrame:
    """The kmer alignment of one region; reads that match nothing are absent.

    All sequences must have one length. Degenerate codes are compared as letters.
    """
    if max_mismatch < 0:
        raise ValueError("max_mismatch must not be negative")
    n_kmers, kmer_length = check_read_lengths(kmers, "kmers")
    n_reads, read_length = check_read_lengths(rep_seq, "representative sequences")
    if n_kmers and n_reads and kmer_length != read_length:
        raise ValueError(f"The reads have {read_length} nt but the kmers {kmer_length} nt; they must be trimmed to one length")
    found = hamming_join(kmers, rep_seq, kmer_length, max_mismatch)
    return found.select("kmer", "asv", F.lit(kmer_length).alias("length"), F.col("mismatch").cast("int"), F.lit(max_mismatch).alias("max_mismatch"), F.lit(region).alias("region"))


def unaligned_reads(alignment: DataFrame, rep_seq: DataFrame) -> DataFrame:
    """Reads that match no kmer."""
    return rep_seq.join(alignment.select(F.col("asv").alias("id")), "id", "left_anti")
