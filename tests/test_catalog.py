"""Queries of the catalog against their SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from strandloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels pages".split()
#: Those that take a few seconds; the driver runs all of them.
QUICK = "trim_table reverse_complement degenerate_count primer_search expand_degenerates extract_kmer_map extract_suffix_reversed align_kmers shared_sets detangle_names normalise_samples taxonomy_merge taxonomy_inherit consensus fasta_round_trip".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


def rows(values):
    return sorted(map(repr, (tuple(r) for r in values)))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    found = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    got = found.select(*columns).collect()
    assert len(got) > 0
    assert rows(got) == rows(want.select(*columns).fetchall())


def test_entry_points(spark):
    known = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(known)
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert all(map(callable, known.values()))


def test_detangling_takes_all_lines(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    sets = {}
    for r in lines:
        i, j = str(r.l_partkey), str(r.l_suppkey)
        sets.setdefault(i, {i}).add(j)
        sets.setdefault(j, {j})
    penalty = {i: len(own) - min(len(sets[j]) for j in own) + 1 for i, own in sets.items()}
    want = {i: "|".join(sorted(j for j in own if penalty[j] == penalty[i])) for i, own in sets.items()}
    found = catalog.QUERIES["detangle_names"](spark, SF_DIR).collect()
    assert len(found) == len(want) > 97
    assert {r.db_seq: r.clean_name for r in found} == want
