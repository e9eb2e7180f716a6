"""Tables that are read several times, written once in the shared folder.

A plan that uses an intermediate result often would otherwise hold it as often
(and so on, at each step), and a lost executor would cost the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only on one machine (a local master) may the session name no such folder;
    then it is a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/strandloom-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
