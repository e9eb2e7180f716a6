"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exactdedup, langid, licenses, neardup, packing, quality, secrets, sharding, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_langid": langid.op2_langid,
    "op3_quality": quality.op3_quality,
    "op4_exact_dedup": exactdedup.op4_exact_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_secrets": secrets.op8_secrets,
    "op9_near_dedup": neardup.op9_near_dedup,
    "op10_licenses": licenses.op10_licenses,
}

SQL: dict[str, str] = {**decontaminate.SQL, **exactdedup.SQL, **licenses.SQL, **neardup.SQL, **warc.SQL}
