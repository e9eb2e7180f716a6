"""Trim read variants to one length after denoising."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trim_dada2_posthoc(table: DataFrame, representative_sequences: DataFrame, trim_length: int = 0, hashed_feature_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """The feature table summed by trimmed sequence, and the trimmed sequences.

    Length 0 takes the shortest sequence's. Shorter sequences are dropped with a
    warning. Ids are the md5 of the sequence, or the sequence. The sequences cover
    all representative ones, whether or not the table has them.
    """
    if trim_length < 0:
        raise ValueError("trim_length must not be negative")
    shortest = representative_sequences.agg(F.min(F.length("sequence"))).first()[0] or 0
    trim_length = trim_length or shortest
    if shortest < trim_length:
        # Fixed text.
        warnings.warn("There are ASVs shorter than the trim length. These sequences will be discarded.", UserWarning, stacklevel=2)
    cut = representative_sequences.where(F.length("sequence") >= trim_length).select("id", F.substring("sequence", 1, trim_length).alias("sequence"))
    new_id = F.md5("sequence") if hashed_feature_ids else F.col("sequence")
    joined = table.join(cut.withColumnRenamed("id", "feature_id"), "feature_id")
    summed = joined.groupBy("sequence", "sample_id").agg(F.sum("count").alias("count"))
    return summed.select(new_id.alias("feature_id"), "sample_id", "count"), cut.select("sequence").distinct().select(new_id.alias("id"), "sequence")
