"""Schemas of the tables, and their column names in files.

Inside, column names use underscores; TSV files use the hyphenated names.
Id sets are ``|``-joined sorted strings, as in the files.
"""

from __future__ import annotations

from pyspark.sql import types as T


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

SEQUENCES = struct(id=S, sequence=S)
KMER_MAP = struct(db_seq=S, seq_name=S, kmer=S, region=S, fwd_primer=S, rev_primer=S, kmer_length=I)
KMER_ALIGNMENT = struct(kmer=S, asv=S, length=I, mismatch=I, max_mismatch=I, region=S)
DATABASE_MAP = struct(db_seq=S, clean_name=S, first_region=I, first_fwd_primer=S, last_region=I, last_fwd_primer=S, last_kmer_length=I)
SUMMARY = struct(feature_id=S, num_regions=I, total_kmers_mapped=L, mean_kmer_per_region=D, stdv_kmer_per_region=D, mapped_asvs=S)
FEATURE_TABLE = struct(feature_id=S, sample_id=S, count=D)
TAXONOMY = struct(feature_id=S, taxon=S)

#: Column names in files that don't follow from replacing underscores by hyphens.
FILE_NAMES = {"clean_name": "clean_name", "seq_name": "seq-name", "taxon": "Taxon"}


def file_name(column: str) -> str:
    return FILE_NAMES.get(column, column.replace("_", "-"))
