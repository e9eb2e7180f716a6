"""Exact deduplication by recipes of content-defined chunks.

Each normalised text is cut where a rolling hash of its last bytes says so. The
chunks are deduplicated by (hash, bytes) in one shuffle, partial sums first, so
a chunk that a third of the documents share is sent once by each task. A hash
that names a single chunk is a verified identifier; one that names several is
extended by the chunk's number. Texts are equal exactly if their ordered
identifier lists are, so documents are compared, grouped and joined by these
short lists, and long texts move once, as chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, append_columns, attach_group, table, texts

#: Bytes of a chunk at least, at most, and (as a mask) on average beyond the least.
LEAST, MOST, MASK = 128, 16384, 1023
HASH_BYTES = 16
SEED = 5

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def rolling(raw: np.ndarray) -> np.ndarray:
    """Gear hashes of the 16 bytes up to each place, by doubling."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
    return h


def cut(docs: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text. They depend on its own bytes only: a cut lies
    at least ``LEAST`` bytes after the last, more than the hash looks back."""
    joined = b"".join(docs)
    places = np.flatnonzero((rolling(np.frombuffer(joined, np.uint8)) & np.uint32(MASK)) == 0) + 1
    out, begin = [], 0
    for doc in docs:
        end, own = begin + len(doc), []
        start = begin
        for p in [*places[np.searchsorted(places, begin) : np.searchsorted(places, end)].tolist(), end]:
            while p - start > MOST:
                own.append(joined[start : start + MOST])
                start += MOST
            if p == end or p - start >= LEAST:
                if p > start:
                    own.append(joined[start:p])
                start = p
        out.append(own)
        begin = end
    return out


def find_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", hash_bytes: int = HASH_BYTES) -> DataFrame:
    """For each row of ``docs``: key, text_sha256, recipe, keep_id, group_size.

    Texts are equal if their bytes are after lower-casing A-Z; null counts as
    empty. keep_id is the largest key among equal texts, group_size counts rows.
    Rows repeated with the same key are one another's copies and share keep_id.
    An empty text has an empty recipe. Very long texts are cut whole.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)

    def digest(chunk: bytes) -> bytes:
        return hashlib.blake2b(chunk, digest_size=hash_bytes).digest()

    def chunks():
        def work(part: pa.RecordBatch) -> list:
            return [[[{"h": digest(c), "c": c} for c in own] for own in cut([normalised(t) for t in texts(part, text)])]]

        return work

    def recipes():
        def work(part: pa.RecordBatch) -> list:
            raw = [normalised(t) for t in texts(part, text)]
            return [[hashlib.sha256(r).hexdigest() for r in raw], [b"".join(map(digest, own)) for own in cut(raw)]]

        return work

    chunk = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("c", T.BinaryType())])
    cuts = append_columns(docs, text, [T.StructField("chunks", T.ArrayType(chunk))], chunks, [key])
    distinct = cuts.select(F.explode("chunks").alias("x")).select("x.h", "x.c").distinct()
    shared = shelf.put(distinct.groupBy("h").count().where("count > 1"), "ambiguous")

    fields = [T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.BinaryType())]
    listed = append_columns(docs, text, fields, recipes, [key])
    if not shared.isEmpty():
        listed = extended(listed, cuts_with_sha(docs, key, text, chunk, digest), shared, key, hash_bytes)
    listed = listed.withColumn("__one", F.lit(1).cast("long"))
    return attach_group(listed, ["recipe"], [key], {"keep_id": ("max", key), "group_size": ("sum", "__one")}).drop("__one")


def cuts_with_sha(docs: DataFrame, key: str, text: str, chunk: T.StructType, digest) -> DataFrame:
    def make():
        def work(part: pa.RecordBatch) -> list:
            raw = [normalised(t) for t in texts(part, text)]
            return [[hashlib.sha256(r).hexdigest() for r in raw], [[{"h": digest(c), "c": c} for c in own] for own in cut(raw)]]

        return work

    return append_columns(docs, text, [T.StructField("text_sha256", T.StringType()), T.StructField("chunks", T.ArrayType(chunk))], make, [key])


def extended(listed: DataFrame, cuts: DataFrame, shared: DataFrame, key: str, hash_bytes: int) -> DataFrame:
    """Recipes in which an ambiguous hash is followed by its chunk's number."""
    places = cuts.select(key, "text_sha256", F.posexplode("chunks").alias("pos", "x")).select(key, "text_sha256", "pos", "x.h", "x.c").join(shared.select("h"), "h", "left_semi")
    number = places.select("h", "c").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("c")))
    marks = places.join(number, ["h", "c"]).groupBy(key, "text_sha256").agg(F.array_join(F.array_sort(F.collect_set(F.format_string("%012d:%d", "pos", "n"))), ",").alias("marks"))
    joined = listed.join(marks, (listed[key].eqNullSafe(marks[key])) & (listed["text_sha256"] == marks["text_sha256"]), "left").select(listed["*"], marks["marks"])
    return joined.withColumn("recipe", F.concat("recipe", F.encode(F.coalesce("marks", F.lit("")), "utf-8"))).drop("marks")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, the one that stays of its equals, and their number."""
    found = find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


SQL = {
    "op4_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""",
}
