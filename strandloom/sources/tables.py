"""TSV files of the four table formats, and feature tables."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom import schemas
from strandloom.store import settle

FORMATS = {
    "kmer-map": schemas.KMER_MAP,
    "kmer-align": schemas.KMER_ALIGNMENT,
    "sidle-reconstruction-mapping": schemas.DATABASE_MAP,
    "sidle-summary": schemas.SUMMARY,
}
NUMERIC = (T.IntegerType, T.LongType, T.DoubleType)


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a line of column types is left out."""
    found = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    return found.where(~F.col(f"`{found.columns[0]}`").startswith("#q2:types"))


def validate_table(spark: SparkSession, path: str, kind: str) -> None:
    """ValueError unless the columns are those of the format and numbers are numbers.

    A reconstruction map may have other length columns than ours.
    """
    found = raw_table(spark, path)
    wanted = {schemas.file_name(f.name): f.dataType for f in FORMATS[kind]}
    if kind == "sidle-reconstruction-mapping":
        if not {"db-seq", "clean_name"} <= set(found.columns):
            raise ValueError("The reconstruction map does not contain the correct columns")
        numeric = [c for c in found.columns if "length" in c]
    else:
        if set(found.columns) != set(wanted):
            # Fixed text for the kmer map.
            raise ValueError(f"The {'KmerMap' if kind == 'kmer-map' else kind} does not contain the correct columns")
        numeric = [c for c, t in wanted.items() if isinstance(t, NUMERIC)]
    for c in numeric:
        if not found.where(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).isEmpty():
            raise ValueError(f"The {c} column must be numeric")  # fixed text


def read_table(spark: SparkSession, path: str, kind: str, validate: bool = False) -> DataFrame:
    """A table of one of ``FORMATS``, columns by name whatever their order in the file.

    A reconstruction map with other columns keeps them; those with ``length`` in
    their name are doubles.
    """
    if validate:
        validate_table(spark, path, kind)
    found = raw_table(spark, path)
    names = {schemas.file_name(f.name): f for f in FORMATS[kind]}
    if kind == "sidle-reconstruction-mapping" and set(found.columns) != set(names):
        return found.select(*((F.col(f"`{c}`").cast("double") if "length" in c else F.col(f"`{c}`")).alias(c.replace("-", "_")) for c in found.columns))
    return found.select(*((F.col(f"`{c}`").cast("double").cast(f.dataType) if isinstance(f.dataType, NUMERIC) else F.col(f"`{c}`")).alias(f.name) for c, f in names.items()))


def one_file(lines: DataFrame, order: list[str], path: str) -> None:
    """The column ``line`` as one text file in the given order; one task sorts and
    writes it, spilling where it must."""
    lines.repartition(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_table(table: DataFrame, path: str, single_file: bool = False) -> None:
    """A table as TSV under the file's column names.

    A summary is one file always, whose first row tells the columns' types, as its
    readers want; its rows are in order of their ids. The files of a kmer map are
    gzipped: each row names all sequences of its kmer, as the rows next to it do.
    """
    names = [schemas.file_name(c) for c in table.columns]
    if set(table.columns) == set(schemas.SUMMARY.names):
        kinds = ["#q2:types"] + ["numeric" if isinstance(table.schema[c].dataType, NUMERIC) else "categorical" for c in table.columns[1:]]  # fixed values
        head = table.sparkSession.createDataFrame([(0, "", "\t".join(names)), (1, "", "\t".join(kinds))], "part int, k string, line string")
        cells = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns)
        return one_file(head.union(table.select(F.lit(2), table.columns[0], F.concat_ws("\t", *cells))), ["part", "k"], path)
    named = table.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(table.columns, names, strict=True)))
    named = named.coalesce(1) if single_file else named
    packed = "gzip" if set(table.columns) == set(schemas.KMER_MAP.names) else "none"
    return named.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", packed).csv(path)


def with_row_id(table: DataFrame, order: list[str]) -> DataFrame:
    """The table with ``id``: row numbers as text in the given order.

    Numbers are the rows before each partition of a range sort plus the place in
    it, so no single task holds the table.
    """
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    # Written once: another run of the range sort could cut elsewhere.
    ranged = settle(ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order))))
    counts = ranged.groupBy("__p").count()
    before = counts.withColumn("__b", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return ranged.join(before, "__p").withColumn("id", (F.col("__b") + F.col("__k") - 1).cast("string")).drop("__p", "__k", "__b")


def read_feature_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A feature-by-sample TSV (the text form of biom) as long rows without zeros."""
    found = spark.read.option("sep", "\t").option("header", True).csv(path)
    key, *samples = found.columns
    # The header may follow a comment line.
    long = found.unpivot([key], samples, "sample_id", "count")
    return long.select(F.col(f"`{key}`").alias("feature_id"), "sample_id", F.col("count").cast("double").alias("count")).where("count <> 0")


def write_feature_tsv(table: DataFrame, path: str) -> None:
    """Long rows as a feature-by-sample TSV, zeros made again here only.

    One file with a line for each feature, in order of the ids. A line holds a
    number for each sample, so the samples' ids must fit in memory, as any
    reader of the format needs; the features need not.
    """
    samples = [r[0] for r in table.select("sample_id").distinct().orderBy("sample_id").collect()]
    head = table.sparkSession.createDataFrame([(0, "", "\t".join(["#OTU ID", *samples]))], "part int, k string, line string")
    cells = table.groupBy("feature_id", "sample_id").agg(F.sum("count").alias("count")).groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "count"))).alias("m"))
    zero = F.lit("0.0")
    line = F.array_join(F.transform(F.lit(samples) if samples else F.array().cast("array<string>"), lambda s: F.coalesce(F.try_element_at("m", s).cast("string"), zero)), "\t")
    one_file(head.union(cells.select(F.lit(1), "feature_id", F.concat_ws("\t", "feature_id", line))), ["part", "k"], path)


def read_biom_json(spark: SparkSession, path: str) -> DataFrame:
    """A biom 1.0 JSON file, sparse or dense, as long rows.

    The ids are taken out of the document once and joined by number.
    """
    doc = spark.read.text(path, wholetext=True)
    shape = "struct<matrix_type:string,rows:array<struct<id:string>>,columns:array<struct<id:string>>,data:array<array<double>>>"
    b = doc.select(F.from_json("value", shape).alias("b")).select("b.*")

    def ids(axis: str, number: str, name: str) -> DataFrame:
        return b.select(F.posexplode(axis).alias(number, "x")).select(number, F.col("x.id").alias(name))

    sparse = b.where("matrix_type = 'sparse'").select(F.explode("data").alias("d")).select(F.col("d")[0].cast("int").alias("r"), F.col("d")[1].cast("int").alias("c"), F.col("d")[2].alias("count"))
    dense = b.where("matrix_type = 'dense'").select(F.posexplode("data").alias("r", "d")).select("r", F.posexplode("d").alias("c", "count"))
    named = sparse.union(dense).where("count <> 0").join(ids("rows", "r", "feature_id"), "r").join(ids("columns", "c", "sample_id"), "c")
    return named.select("feature_id", "sample_id", "count")


def write_biom_json(table: DataFrame, path: str) -> None:
    """Long rows as one biom 1.0 JSON document in one file.

    Every id and every count is a line of the document, which is sorted and
    written line by line; no row holds the table.
    """
    cells = settle(table.groupBy("feature_id", "sample_id").agg(F.sum("count").alias("count")).where("count <> 0"))
    rows, columns = (settle(with_row_id(cells.select(c).distinct(), [c]).select(c, F.col("id").cast("int").alias("n"))) for c in ("feature_id", "sample_id"))
    n_rows, n_columns = rows.count(), columns.count()
    head = json.dumps({"id": None, "format": "Biological Observation Matrix 1.0.0", "type": "OTU table", "matrix_type": "sparse", "matrix_element_type": "float", "shape": [n_rows, n_columns]})[:-1]
    marks = [(0, 0, head + ', "rows": ['), (2, 0, '], "columns": ['), (4, 0, '], "data": ['), (6, 0, "]}")]
    parts = [table.sparkSession.createDataFrame(marks, "part int, k long, line string")]
    for part, df, c in ((1, rows, "feature_id"), (3, columns, "sample_id")):
        named = F.to_json(F.struct(F.col(c).alias("id"), F.lit(None).cast("string").alias("metadata")), {"ignoreNullFields": "false"})
        parts.append(df.select(F.lit(part).alias("part"), F.col("n").cast("long").alias("k"), F.concat(F.when(F.col("n") > 0, ",").otherwise(""), named).alias("line")))
    placed = cells.join(rows.withColumnRenamed("n", "r"), "feature_id").join(columns.withColumnRenamed("n", "c"), "sample_id")
    at = F.col("r").cast("long") * n_columns + F.col("c")
    first = placed.agg(F.min(at)).first()[0]
    value = F.concat(F.lit("["), F.concat_ws(",", F.col("r").cast("string"), F.col("c").cast("string"), F.col("count").cast("string")), F.lit("]"))
    parts.append(placed.select(F.lit(5).alias("part"), at.alias("k"), F.concat(F.when(at > F.lit(first), ",").otherwise(""), value).alias("line")))
    one_file(functools.reduce(DataFrame.union, parts), ["part", "k"], path)
