"""Quality classifier: a byte convolutional network over overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytecnn import ByteCNN, averaged, chunked, softmax
from .common import append_columns, table, texts
from .langid import bounded_bytes, bounded_sample, remainder

#: Bytes of a chunk, and where the next begins.
LENGTH, STRIDE = 512, 448
#: Rows of one class that a model is fitted on at most, whole texts each.
PER_CLASS = 1000
#: A class's rows are taken until their texts have so many bytes.
SAMPLE_BYTES = 16 << 20
EPOCHS, BATCH = 6, 32


def fit_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> ByteCNN | None:
    """A network for P(label 1), from at most ``per_class`` labelled rows of each class.

    A document with several labels has their mean, rounded; of several texts of
    one key the least counts. The rows' texts are taken whole, all chunks of each,
    up to the row that passes ``SAMPLE_BYTES`` for its class. The bounded sample of
    labels is broadcast; only its texts are shuffled. None if a class is missing.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = bounded_sample(marks, "y", ["k"], per_class)  # at most 2 * per_class rows
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t"))
    sample = bounded_bytes(rows, "y", "t", ["k"], SAMPLE_BYTES).collect()
    if len({r.y for r in sample}) < 2:
        return None
    sample.sort(key=lambda r: (str(r.k), r.y))
    codes, owner, _ = chunked([r.t for r in sample], LENGTH, STRIDE)
    groups = np.split(codes, np.flatnonzero(np.diff(owner)) + 1)
    return ByteCNN(2).fit(groups, np.array([r.y for r in sample]), EPOCHS, BATCH)


def score_quality(docs: DataFrame, net: ByteCNN | None, *, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with ``score``, the probability of label 1.

    Every text is read whole, in overlapping chunks; the chunks' pooled features
    are averaged by length into one probability. Null counts as empty, an empty
    text is one padded chunk. Without a model every score is 0.5. Repeated rows
    get equal scores, an empty table stays empty, and columns of the new name are
    replaced. Narrow: no shuffle.
    """

    def make():
        def work(part: pa.RecordBatch) -> list:
            listed = texts(part, text)
            if net is None:
                return [[0.5] * len(listed)]
            codes, owner, weight = chunked(listed, LENGTH, STRIDE)
            mean = averaged(net.features(codes), owner, weight, len(listed))
            return [softmax(net.logits(mean))[:, 1].clip(0, 1).tolist()]

        return work

    return append_columns(docs, text, [T.StructField(score, T.DoubleType())], make, list(docs.columns if keep is None else keep))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; learned where crc32(doc_id) mod 3 is not 1.

    A document without doc_id is in no fold: held_out is null, and it teaches nothing.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit_quality(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    found = score_quality(docs, net, keep=["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
