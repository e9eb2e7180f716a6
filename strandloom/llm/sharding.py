"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records by seeded hashes: a record's shard is the one
that wins a rendezvous of hashes of its key, and within a shard it goes to one
of so many buckets that a bucket fits in memory. Records are dealt by bucket, so
a task holds one bucket (some, if there are more than ``MOST_TASKS``). Pass two
sorts each bucket (so that a repeated task finds the same order), shuffles it by
Fisher-Yates (which Spark's ``shuffle`` is) and writes it out; the slots of a bucket
follow those of the shard's buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import others, shared_dir, table

SHARDS = 24
SEED = 20
#: Bytes of a bucket on average.
BUCKET_BYTES = 4 << 20
#: Tasks of pass two at most.
MOST_TASKS = 1 << 16


def winner(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the greatest hash. One shard more takes rows only into itself."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), j, key).alias("h"), j.alias("j")))
    return F.array_max(drawn)["j"]


def external_shuffle(rows: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` (all columns, of sortable types) with shard, slot and grown_shard.

    ``key`` and the number of shards alone decide the shard (law ``key``);
    grown_shard is the shard with one shard more. Slots run from 0 without gaps
    in each shard. Null keys go to one shard together; null texts have no
    bytes. Rows that repeat key and text share a bucket, in which each has a slot of
    its own. Empty tables stay empty. Columns of the new names, in any case, are
    replaced.
    """
    rows = rows.select(*(F.col(f"`{c}`") for c in others(rows.columns, ["shard", "slot", "grown_shard"]))).withColumns({"shard": winner(F.col(key), shards, seed), "grown_shard": winner(F.col(key), shards + 1, seed)})
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64), F.lit(0))).first()[0]
    per_shard = max(1, -(-int(total) // (bucket_bytes * shards)))
    number = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(per_shard))
    rows = rows.withColumn("__bucket", F.col("shard") * F.lit(per_shard).cast("long") + number)
    tasks = min(MOST_TASKS, per_shard * shards)
    turn = F.pmod("__bucket", F.lit(tasks)).cast("int")

    counts = rows.groupBy("__bucket", "shard").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))

    own = [c for c in rows.columns if c != "__bucket"]
    record = F.struct(F.xxhash64(F.lit(seed + 2), F.col(key), F.col(text)).alias("__h"), *(F.col(f"`{c}`") for c in own))
    dealt = rows.withColumn("__turn", turn).repartitionById(tasks, F.col("__turn"))
    buckets = dealt.groupBy("__turn", "__bucket").agg(F.sort_array(F.collect_list(record)).alias("__rows"))
    placed = buckets.join(F.broadcast(first), "__bucket") if tasks == per_shard * shards else buckets.join(first.hint("merge"), "__bucket").sortWithinPartitions("__bucket")
    mixed = placed.withColumn("__rows", F.shuffle("__rows", seed))
    out = mixed.select("__first", F.posexplode("__rows").alias("__k", "__row"))
    return out.select(*(F.col("__row")[c].alias(c) for c in own), (F.col("__first") + F.col("__k")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """One folder for each shard, its records by slot within each file; the table as read back.

    An empty table leaves an empty folder and reads back empty.
    """
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, and its shard if there were one more.

    The shards are written below the shared folder; the rows are those read back.
    """
    mixed = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    mixed = write_shards(mixed, f"{shared_dir(spark)}/shards")
    body = F.coalesce("text", F.lit(""))
    return mixed.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
