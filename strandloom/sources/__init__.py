"""Readers and writers of the files that the tables come in."""

from .fasta import read_fasta, write_fasta
from .tables import (
    read_biom_json,
    read_feature_tsv,
    read_table,
    validate_table,
    with_row_id,
    write_biom_json,
    write_feature_tsv,
    write_table,
)

__all__ = [
    "read_biom_json",
    "read_fasta",
    "read_feature_tsv",
    "read_table",
    "validate_table",
    "with_row_id",
    "write_biom_json",
    "write_fasta",
    "write_feature_tsv",
    "write_table",
]
