"""The two pipelines over the operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from strandloom.operators.counts import reconstruct_counts
from strandloom.operators.database import reconstruct_database
from strandloom.operators.fragments import reconstruct_fragment_rep_seqs
from strandloom.operators.taxonomy import reconstruct_taxonomy
from strandloom.sources import write_fasta
from strandloom.store import settle


class Reconstruction(NamedTuple):
    database_map: DataFrame
    summary: DataFrame
    table: DataFrame
    taxonomy: DataFrame


def reconstruct_profiles(
    region: Sequence[str],
    kmer_map: Sequence[DataFrame],
    regional_alignment: Sequence[DataFrame],
    regional_table: Sequence[DataFrame],
    reference_taxonomy: DataFrame,
    database: str = "none",
    define_missing: str = "merge",
    ambiguity_handling: str = "ignore",
    per_nucleotide_error: float = 0.005,
    min_abund: float = 1e-5,
    min_counts: float = 1000,
) -> Reconstruction:
    """Database, counts and taxonomy. Degenerates are counted, counts are averaged over regions."""
    names, summary = reconstruct_database(region, regional_alignment, kmer_map, count_degenerates=True)
    summary = settle(summary)
    table = reconstruct_counts(region, regional_alignment, regional_table, names, summary, per_nucleotide_error, min_abund, "average", min_counts)
    return Reconstruction(names, summary, table, reconstruct_taxonomy(names, reference_taxonomy, database, define_missing, ambiguity_handling))


def reconstruct_tree(reconstruction_map: DataFrame, reconstruction_summary: DataFrame, aligned_sequences: DataFrame, fasta_path: str | None = None) -> DataFrame:
    """The fragments to be placed in a tree, written as FASTA if a path is given.

    The placement itself is an external program's work.
    """
    fragments = reconstruct_fragment_rep_seqs(reconstruction_map, reconstruction_summary, aligned_sequences)
    if fasta_path is not None:
        write_fasta(fragments, fasta_path, single_file=True)
    return fragments


def exclude_taxa(taxonomy: DataFrame, sequences: DataFrame, substrings: Sequence[str]) -> DataFrame:
    """Sequences whose taxon holds none of the substrings, whatever their case."""
    from pyspark.sql import functions as F

    out = taxonomy
    for s in substrings:
        out = out.where(~F.contains(F.lower("taxon"), F.lit(s.lower())))
    return sequences.join(out.select(F.col("feature_id").alias("id")), "id", "left_semi")
