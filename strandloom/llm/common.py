"""Helpers shared by the corpus operators.

Nothing here collects rows whose number grows with the corpus, and nothing
is written outside the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch sent to a Python worker. A batch also holds long
#: texts, so the default of 10,000 rows is too many for small executors.
BATCH_ROWS = 2000

#: Text bytes that a Python worker handles at once; a longer text is alone.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``, if it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only on one machine (a local master) may the session name none; then it is a
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/strandloom-{uuid.uuid4().hex}"


class Shelf:
    """Intermediate tables of one query, written as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark)
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Drop all but these."""
        for name in self.names.difference(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def append_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    keep: Sequence[str],
    read: Sequence[str] = (),
) -> DataFrame:
    """``df``'s columns ``keep`` and new ones that Python makes from slices of rows,
    which also hold the columns ``read``.

    ``make`` runs once in each task and returns the function that turns a slice
    of at most ``SLICE_BYTES`` of text into one array for each of ``fields``.
    A new column replaces kept ones of its name in any case, as ``withColumn`` does.
    Narrow: one row out for each row in, no shuffle, memory bounded by a slice.
    """
    small_batches(df.sparkSession)
    keep = others(keep, [f.name for f in fields])
    names = [*keep, *(f.name for f in fields)]
    kinds = [f.dataType for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(k) for k in kinds]
        work = make()
        for batch in batches:
            for part in slices(batch.rename_columns(wanted), text):
                new = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(work(part), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in keep] + new, names)

    wanted = list(dict.fromkeys([*keep, text, *read]))
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])
    # By number, as mapInArrow can't read a name with a dot.
    return df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(wanted))).mapInArrow(run, schema)


def others(columns: Sequence[str], new: Sequence[str]) -> list[str]:
    """``columns`` without those that one of ``new`` replaces; case doesn't tell names apart."""
    taken = {n.lower() for n in new}
    return [c for c in columns if c.lower() not in taken]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one batch that hold at most ``SLICE_BYTES`` of text."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(size):
        if k > start and held + n > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(part: pa.RecordBatch, text: str) -> list[str]:
    return [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def salts(spark: SparkSession) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def attach_group(df: DataFrame, key: Sequence[str], spread: Sequence[str], aggs: dict[str, tuple[str, str]], then: Callable[[DataFrame], DataFrame] = lambda whole: whole) -> DataFrame:
    """Add to each row what an aggregate says of all rows with its ``key``.

    ``aggs`` maps a new column to (max|min|sum, column). The join is on the key
    and a salt hashed from ``spread``, so a key that holds a third of all rows
    is dealt over as many tasks as there are shuffle partitions; before a whole
    key meets in one task, it has one row for each salt at most.
    """
    how = {"max": F.max, "min": F.min, "sum": F.sum}
    n = salts(df.sparkSession)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread)), F.lit(n)).cast("int"))
    some = salted.groupBy(*key, "__salt").agg(*(how[f](f"`{c}`").alias(f"__p_{out}") for out, (f, c) in aggs.items()))
    whole = some.groupBy(*key).agg(*(how[f](f"__p_{out}").alias(out) for out, (f, _) in aggs.items()))
    told = some.select(*key, "__salt").join(then(whole), list(key))
    return salted.join(told, [*key, "__salt"]).drop("__salt")
