"""Abundances of reconstructed sequences by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import iupac
from strandloom.operators.database import kmer_members
from strandloom.sources.tables import with_row_id
from strandloom.store import settle

EPS = 2.220446049250313e-16
MAX_STEPS, STOP_ERROR = 100_000, 1e-7
NORMALISE = ("average", "weighted", "unweighted")


def require_known(rows: DataFrame, known: DataFrame, key: str, what: str) -> None:
    """KeyError if a key of ``rows`` is not in ``known``."""
    missing = rows.select(key).join(known.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"{what} lacks {sorted(str(r[0]) for r in missing)}")


def alignment_matrix(alignment: DataFrame, names: DataFrame, summary: DataFrame, error: float = 0.005, check: bool = True) -> DataFrame:
    """One row for each (clean_name, asv, region, max_mismatch), with the error model."""
    members = settle(kmer_members([alignment]))
    known = settle(names.select("db_seq", iupac.short("clean_name").alias("name")))
    if check:
        require_known(members, known, "db_seq", "the database map")
    # The names of each kmer, with keys for both until they are distinct.
    labels = names.select(iupac.short("clean_name").alias("name"), "clean_name").distinct()
    regions = summary.select(iupac.short("feature_id").alias("name"), "num_regions")
    named = members.join(known, "db_seq").select("key", "name").distinct().join(labels, "name").join(regions, "name", "left").drop("name")
    rows = alignment.select(iupac.short("kmer").alias("key"), "asv", "region", "max_mismatch", "mismatch", "length")
    best = rows.join(settle(named), "key").groupBy("clean_name", "asv", "region", "max_mismatch").agg(F.min("mismatch").alias("mismatch"), F.min("length").alias("length"), F.max("num_regions").alias("num_regions"))
    right, wrong = F.lit(1.0 - error), F.lit(error / 3)

    def chance(misses):
        return F.pow(right, F.col("length") - misses) * F.pow(wrong, misses)

    out = best.withColumns({"match_prob": chance(F.col("mismatch")), "perfect_prob": F.pow(right, "length"), "max_error_prob": chance(F.col("max_mismatch"))})
    out = out.withColumn("error_thresh", F.col("perfect_prob") - 0.1 * F.col("max_error_prob") - EPS)
    out = out.withColumn("perf_match", F.col("match_prob") > F.col("error_thresh"))
    return out.withColumn("norm", F.col("match_prob") / F.col("num_regions")).drop("num_regions")


def pivot_mean(matrix: DataFrame) -> DataFrame:
    """(asv, clean_name, a): the mean over regions, kept long."""
    return matrix.groupBy("asv", "clean_name").agg(F.avg("norm").alias("a"))


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Equal (feature, sample) of several tables are summed."""
    every = reduce(DataFrame.unionByName, (t.select("feature_id", "sample_id", "count") for t in tables))
    return every.groupBy("feature_id", "sample_id").agg(F.sum("count").alias("count"))


def check_depth(table: DataFrame, kept: DataFrame, min_counts: float) -> None:
    """ValueError unless every sample's kept counts exceed ``min_counts``."""
    samples = table.select("sample_id").distinct()
    depth = kept.groupBy("sample_id").agg(F.sum("count").alias("depth"))
    low = samples.join(depth, "sample_id", "left").where(~(F.coalesce("depth", F.lit(0.0)) > min_counts)).count()
    if low:
        # Fixed text.
        raise ValueError(
            f"There are {low} samples with fewer than {min_counts} total sequences. "
            "Please check your minimum counts and make sure your representative sequences are aligned with the database."
        )


def normalise_samples(table: DataFrame, value: str = "count", out: str = "y") -> DataFrame:
    """Shares of each sample's total."""
    totals = table.groupBy("sample_id").agg(F.sum(value).alias("__total"))
    return table.join(totals, "sample_id").withColumn(out, F.col(value) / F.col("__total")).drop("__total")


def solve_em(row: np.ndarray, column: np.ndarray, a: np.ndarray, y: np.ndarray, min_abund: float) -> np.ndarray:
    """Shares of the columns of one sparse matrix (row, column, a) for abundances y.

    Columns whose share falls to ``min_abund`` leave the iteration.
    """
    n_rows, n_cols = len(y), int(column.max()) + 1 if len(column) else 0
    f = np.bincount(column, a * y[row], n_cols)
    f /= f.sum()
    alive = np.ones(n_cols, bool)
    for _ in range(MAX_STEPS):
        theta = np.bincount(row, a * f[column], n_rows)
        b = np.bincount(column, a * (y / (theta + EPS))[row], n_cols)
        error = float((np.abs(1 - b) * f)[alive].sum())
        f = f * b
        if error < STOP_ERROR:
            break
        low = alive & (f <= min_abund)
        if low.any():
            alive &= ~low
            f[low] = 0
            on = alive[column]
            row, column, a = row[on], column[on], a[on]
    f[f <= min_abund] = 0
    if not f.sum() > 0:
        raise ValueError("no sequence of the sample keeps an abundance above min_abund")
    return f / f.sum()


class Packed(NamedTuple):
    """A matrix with numbers for names: (clean_name, n) in order, and (asv, n, a) with
    one row for each read, its names and chances as arrays."""

    names: DataFrame
    rows: DataFrame


def pack(matrix: DataFrame) -> Packed:
    """The matrix as it goes to each sample, a few bytes for each entry."""
    names = settle(with_row_id(matrix.select("clean_name").distinct(), ["clean_name"]).select("clean_name", F.col("id").cast("int").alias("n")))
    entries = matrix.join(names, "clean_name").groupBy("asv").agg(F.array_sort(F.collect_list(F.struct("n", "a"))).alias("x"))
    return Packed(names, settle(entries.select("asv", "x.n", "x.a")))


def entries(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """One sample's rows in order, and the entries' rows, names and chances."""
    rows = rows.sort_values("asv", kind="stable")
    row = np.repeat(np.arange(len(rows)), rows["n"].map(len).to_numpy(int))
    return rows, row, np.concatenate([*rows["n"]]), np.concatenate([*rows["a"]])


def solve_packed(shares: DataFrame, matrix: Packed, min_abund: float) -> DataFrame:
    """``solve_samples`` with a packed matrix."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, row, column, a = entries(rows)
        y = rows["y"].to_numpy()
        del rows
        if not (a > 0).all():
            row, column, a = row[a > 0], column[a > 0], a[a > 0]
        used = np.bincount(column) > 0
        met, column = np.flatnonzero(used), (np.cumsum(used) - 1)[column]
        try:
            f = solve_em(row, column, a, y, min_abund)
        except ValueError as why:
            raise ValueError(f"sample {key[0]}: {why}") from None
        return pd.DataFrame({"sample_id": key[0], "n": met, "f": f})

    usable = matrix.rows.where(F.exists("a", lambda x: x > 0))
    rows = shares.where("y > 0").select("sample_id", F.col("feature_id").alias("asv"), "y").join(usable, "asv")
    found = rows.groupBy("sample_id").applyInPandas(solve, "sample_id string, n int, f double").where("f > 0")
    return found.join(matrix.names, "n").select("sample_id", "clean_name", "f")


def solve_samples(shares: DataFrame, matrix: DataFrame, min_abund: float = 1e-5) -> DataFrame:
    """(sample_id, clean_name, f): one grouped task for each sample; rows are
    sorted first, so sums don't depend on the order of arrival."""
    return solve_packed(shares, pack(matrix), min_abund)


def per_region(solved: DataFrame, summary: DataFrame) -> DataFrame:
    """Shares divided by the number of regions, then scaled to 1 again."""
    regions = summary.select(F.col("feature_id").alias("clean_name"), "num_regions")
    divided = solved.join(regions, "clean_name").select("sample_id", "clean_name", (F.col("f") / F.col("num_regions")).alias("f"))
    return normalise_samples(divided, "f", "g").select("sample_id", "clean_name", F.col("g").alias("f"))


def scale_counts(table: DataFrame, shares: DataFrame, matrix: DataFrame, summary: DataFrame, region_normalize: str = "average", total_regions: int = 1) -> DataFrame:
    """(feature_id, sample_id, count): each read's counts dealt over its sequences, rounded half to even."""
    return scale_packed(table, shares, pack(matrix), summary, region_normalize, total_regions)


def scale_packed(table: DataFrame, shares: DataFrame, matrix: Packed, summary: DataFrame, region_normalize: str, total_regions: int) -> DataFrame:
    """``scale_counts`` with a packed matrix; one task for each sample, as in the solution."""

    def deal(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(known):
            return pd.DataFrame({"sample_id": [], "n": [], "v": []})
        rows, row, column, a = entries(rows)
        known = known.sort_values("n")
        met, at = known["n"].to_numpy(), np.searchsorted(known["n"].to_numpy(), column).clip(max=len(known) - 1)
        on = met[at] == column
        row, at, a = row[on], at[on], a[on]
        p = known["f"].to_numpy()[at] * a
        sums = np.bincount(row, p, len(rows))
        v = np.bincount(at, rows["count"].to_numpy()[row] * p / (sums[row] + EPS), len(known))
        dealt = np.bincount(at, minlength=len(known)) > 0
        return pd.DataFrame({"sample_id": key[0], "n": met[dealt], "v": v[dealt]})

    rows = table.where("count > 0").select("sample_id", F.col("feature_id").alias("asv"), F.col("count").cast("double").alias("count")).join(matrix.rows, "asv")
    known = shares.where("f > 0").join(matrix.names, "clean_name").select("sample_id", "n", "f")
    dealt = rows.groupBy("sample_id").cogroup(known.groupBy("sample_id")).applyInPandas(deal, "sample_id string, n int, v double")
    totals = dealt.join(matrix.names, "n").select("clean_name", "sample_id", "v")
    regions = summary.select(F.col("feature_id").alias("clean_name"), "num_regions")
    factor = {"average": 1 / F.col("num_regions"), "weighted": F.lit(float(total_regions)) / F.col("num_regions")}.get(region_normalize, F.lit(1.0))
    value = F.col("v") / F.col("num_regions") if region_normalize == "average" else F.col("v") * factor
    out = totals.join(regions, "clean_name").select(F.col("clean_name").alias("feature_id"), "sample_id", F.rint(value).alias("count"))
    return out.where("count > 0")


def reconstruct_counts(
    region: Sequence[str],
    regional_alignment: Sequence[DataFrame],
    regional_table: Sequence[DataFrame],
    database_map: DataFrame,
    database_summary: DataFrame,
    per_nucleotide_error: float = 0.005,
    min_abund: float = 1e-5,
    region_normalize: str = "average",
    min_counts: float = 1000,
) -> DataFrame:
    """The reconstructed feature table, long and without zeros."""
    if not 0 <= per_nucleotide_error < 1 or not 0 <= min_abund < 1:
        raise ValueError("per_nucleotide_error and min_abund must be at least 0 and less than 1")
    if region_normalize not in NORMALISE:
        raise ValueError(f"region_normalize must be one of {', '.join(NORMALISE)}")
    if min_counts < 0:
        raise ValueError("min_counts must not be negative")
    summary = database_summary
    if region_normalize == "unweighted":
        summary = summary.withColumn("num_regions", F.lit(1))
    alignment = reduce(DataFrame.unionByName, regional_alignment)
    matrix = settle(pivot_mean(alignment_matrix(alignment, database_map, summary, per_nucleotide_error)))
    table = settle(union_tables(regional_table))
    kept = table.join(alignment.select(F.col("asv").alias("feature_id")), "feature_id", "left_semi")
    check_depth(table, kept, min_counts)
    shares = normalise_samples(kept.where("count > 0"))
    packed = pack(matrix)
    solved = settle(per_region(settle(solve_packed(shares, packed, min_abund)), summary))
    return scale_packed(kept, solved, packed, summary, region_normalize, len(set(region)))


