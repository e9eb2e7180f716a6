"""Language identification with a byte convolutional network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytecnn import SPAN, ByteCNN, averaged, chunked, softmax
from .common import append_columns, table, texts

#: Bytes of a window, and where the next begins: no filter's place is lost between.
LENGTH = 256
STRIDE = LENGTH - (SPAN - 1)
#: Rows of one class that a model is fitted on at most, whole texts each.
PER_CLASS = 400
#: A class's rows are taken until their texts have so many bytes.
SAMPLE_BYTES = 8 << 20
EPOCHS, BATCH = 2, 64


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, label: str, order: list[str], per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, chosen by a hash of ``order``.

    Rows are thinned by rate before the exact cut, so a frequent label's rows
    don't meet in one task. Labels are looked up in one map, however many there are.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    rates = ((value, min(1.0, 1.5 * per_class / n + 20 / n)) for value, n in sorted(counts.items(), key=str))
    rate = F.create_map(*(F.lit(x) for pair in rates for x in pair))[F.col(label)]
    drawn = rows.withColumn("__h", F.xxhash64(F.lit(20), *(F.col(c) for c in order)))
    drawn = drawn.where(F.pmod("__h", F.lit(1 << 20)) < rate * (1 << 20))
    first = Window.partitionBy(label).orderBy("__h", *order)
    return drawn.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_class).drop("__n", "__h")


def bounded_bytes(sample: DataFrame, label: str, text: str, order: list[str], limit: int) -> DataFrame:
    """Rows of a bounded sample, whole, until each label's texts have ``limit`` bytes; one row of a label at least."""
    before = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(20), *(F.col(c) for c in order)), *order).rowsBetween(Window.unboundedPreceding, -1)
    return sample.withColumn("__b", F.coalesce(F.sum(F.octet_length(text)).over(before), F.lit(0))).where(F.col("__b") < limit).drop("__b")


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_class: int = PER_CLASS) -> tuple[ByteCNN | None, list[str]]:
    """A network and its classes, from at most ``per_class`` rows of each language.

    The rows' texts are taken whole, every window of each, up to the row that
    passes ``SAMPLE_BYTES`` for its language. Rows without text or language teach
    nothing; without any the network is None.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("t"))
    sample = bounded_bytes(bounded_sample(rows, "y", ["k", "t"], per_class), "y", "t", ["k", "t"], SAMPLE_BYTES).collect()
    if not sample:
        return None, []
    sample.sort(key=lambda r: (str(r.k), r.y, r.t))
    classes = sorted({r.y for r in sample})
    codes, owner, _ = chunked([r.t for r in sample], LENGTH, STRIDE)
    labels = np.array([classes.index(r.y) for r in sample])[owner]
    return ByteCNN(len(classes)).fit([codes[k : k + 1] for k in range(len(codes))], labels, EPOCHS, BATCH), classes


def predict_languages(docs: DataFrame, net: ByteCNN | None, classes: list[str], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with lang_pred and score (the mean probability over its windows).

    A null text or one without a letter is ``und`` with score 0, and so is every
    text if nothing was learned. Texts are read whole, in windows of ``LENGTH``
    bytes. Repeated rows get equal answers. An empty table stays empty; columns of
    the new names are replaced. Narrow: no shuffle.
    """

    def make():
        def work(part: pa.RecordBatch) -> list:
            listed = texts(part, text)
            spoken = [any(map(str.isalpha, t)) for t in listed]
            if net is None:
                return [["und"] * len(listed), [0.0] * len(listed)]
            codes, owner, weight = chunked([t if s else "" for t, s in zip(listed, spoken, strict=True)], LENGTH, STRIDE)
            mean = averaged(softmax(net.logits(net.features(codes))), owner, weight, len(listed))
            best = mean.argmax(axis=1)
            return [
                [classes[b] if s else "und" for b, s in zip(best.tolist(), spoken, strict=True)],
                [min(1.0, float(mean[k, b])) if s else 0.0 for k, (b, s) in enumerate(zip(best.tolist(), spoken, strict=True))],
            ]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, text, fields, make, list(docs.columns if keep is None else keep))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned where crc32(doc_id) mod 5 is not 0.

    A document without doc_id is in no fold: held_out is null, and it teaches nothing.
    """
    docs = table(spark, sf_dir, "documents")
    net, classes = fit_languages(docs.where(remainder(F.col("doc_id"), 5) != 0))
    found = predict_languages(docs, net, classes, keep=["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
