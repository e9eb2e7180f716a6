"""What many sequences of few kmers cost, and that nothing of their sets is lost."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import schemas, sources
from strandloom.operators import align, counts, database, extract, taxonomy
from strandloom.store import settle

KMERS, REGIONS = ["ACGTA", "CCGTA", "GGGTT"], ["A", "B"]
ENDS = ["".join(x) for x in itertools.product("ACGT", repeat=5)]


def two_regions(spark, n):
    """Kmer maps and alignments: three kmers in A, up to 1024 in B, which lacks every third sequence."""
    rows = [(f"d{k:07}", KMERS[k % 3] + ENDS[k * 7 % 1024]) for k in range(n)]
    maps, aligned = [], []
    for region, length in (("A", 5), ("B", -5)):
        own = spark.createDataFrame([r for k, r in enumerate(rows) if region == "A" or k % 7 % 3], schemas.SEQUENCES)
        kmers, found = extract.prepare_extracted_region(own, region, length, "A", "C")
        reads = kmers.select(F.concat(F.lit(region), "sequence").alias("id"), "sequence")
        maps.append(found)
        aligned.append(align.align_regional_kmers(kmers, reads, region, 0))
    return maps, aligned


def moved(spark):
    """Bytes that this session's shuffles have written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_database_moves_no_kmer_with_each_row(spark):
    maps, aligned = two_regions(spark, 3000)
    before = moved(spark)
    found, _ = database.reconstruct_database(REGIONS, aligned, maps)
    assert found.count() == 3000
    assert moved(spark) - before < 4e6


def set_of(k, held, own):
    """Brute force: the sequences that share a kmer with ``k`` in each region of it."""
    return sorted(j for j, theirs in held.items() if all(own[k][r] & theirs.get(r, set()) for r in own[k]))


@pytest.mark.parametrize("choices", [0, 2, 64])
def test_shared_sets_of_lists_of_many_kmers(spark, choices, monkeypatch):
    monkeypatch.setattr(database, "CHOICES", choices)
    rng = np.random.default_rng(5)
    own = {f"s{i:02}": {r: set(map(int, rng.integers(0, 6, rng.integers(1, 4)))) for r in range(3) if r == i % 3 or rng.random() < 0.6} for i in range(40)}
    # A kmer names those that have it.
    names = {(r, x): "|".join(sorted(i for i in own if x in own[i].get(r, ()))) for r in range(3) for x in range(6)}
    rows = [(i, i, names[r, x], r) for i, parts in own.items() for r, xs in parts.items() for x in xs]
    kmers = spark.createDataFrame(rows, "db_seq string, seq_name string, kmer string, region int")
    owners, sets = database.shared_sets(kmers.withColumn("key", database.iupac.short("kmer")), database.kmer_members([kmers], "region"))
    found = {}
    for r in owners.join(sets, "sig").collect():
        found.setdefault(r.db_seq, []).append(r.j)
    assert {i: sorted(js) for i, js in found.items()} == {i: set_of(i, own, own) for i in own}


def test_kmer_map_is_packed_in_files(spark, tmp_path):
    maps, _ = two_regions(spark, 3000)
    path = tmp_path / "map"
    sources.write_table(maps[0], str(path))
    assert sum(p.stat().st_size for p in path.iterdir()) < 1e6  # each row names a thousand sequences
    back = sources.read_table(spark, str(path), "kmer-map", validate=True)
    assert back.exceptAll(maps[0]).isEmpty()
    assert back.count() == 3000


def groups(spark):
    """A database map of 30 groups of 100 sequences, and its groups' names."""
    ids = [hashlib.md5(str(k).encode()).hexdigest() for k in range(3000)]
    names = ["|".join(sorted(ids[g::30])) for g in range(30)]
    return settle(spark.createDataFrame([(i, names[k % 30]) for k, i in enumerate(ids)], "db_seq string, clean_name string")), names


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, was)


def test_alignment_matrix_moves_no_name_with_each_sequence(spark, no_broadcast):
    known, names = groups(spark)
    alignment = spark.createDataFrame([(n, f"r{g}", 15, 0, 1, "A") for g, n in enumerate(names)], schemas.KMER_ALIGNMENT)
    summary = spark.createDataFrame([(n, 2) for n in names], "feature_id string, num_regions int")
    before = moved(spark)
    found = counts.alignment_matrix(alignment, known, summary).select("asv", "clean_name", F.round("norm", 9).alias("x")).collect()
    assert sorted(map(tuple, found)) == sorted((f"r{g}", n, round(0.995**15 / 2, 9)) for g, n in enumerate(names))
    assert moved(spark) - before < 3e6


def test_taxonomy_moves_no_name_with_each_row(spark, no_broadcast):
    known, names = groups(spark)
    taxa = settle(known.select(F.col("db_seq").alias("feature_id"), F.lit("k__x;p__y").alias("taxon")))
    before = moved(spark)
    found = taxonomy.reconstruct_taxonomy(known, taxa, "silva").collect()
    assert sorted(map(tuple, found)) == [(n, "k__x;p__y") for n in sorted(names)]
    assert moved(spark) - before < 2e6


def test_samples_move_few_bytes_for_each_entry(spark, no_broadcast):
    rng = np.random.default_rng(7)
    names, samples = [hashlib.md5(bytes([k % 256, k // 256])).hexdigest() for k in range(500)], [f"sample{k}" for k in range(8)]
    rows = [(f"r{r:02}", n, float(a)) for r in range(60) for n, a in zip(names, rng.choice([0.0, 0.25, 0.5, 0.75], 500), strict=True) if a or n < "8"]
    matrix = settle(spark.createDataFrame(rows, "asv string, clean_name string, a double"))
    table = settle(spark.createDataFrame([(f"r{r:02}", s, float(rng.integers(1, 10**6))) for r in range(60) for s in samples], schemas.FEATURE_TABLE))
    shares = settle(spark.createDataFrame([(s, n, float(f)) for s in samples for n, f in zip(names, rng.random(500), strict=True) if f > 0.2], "sample_id string, clean_name string, f double"))
    summary = spark.createDataFrame([(n, 1) for n in names], "feature_id string, num_regions int")
    before = moved(spark)
    got = {(r.sample_id, r.feature_id): r["count"] for r in counts.scale_counts(table, shares, matrix, summary).collect()}
    assert moved(spark) - before < 2e6
    f = {(r.sample_id, r.clean_name): r.f for r in shares.collect()}
    want = {}
    for t in table.collect():
        p = {n: a * f[t.sample_id, n] for r, n, a in rows if r == t.feature_id and (t.sample_id, n) in f}
        total = sum(p.values()) + counts.EPS
        for n, x in p.items():
            want[t.sample_id, n] = want.get((t.sample_id, n), 0) + t["count"] * x / total
    assert got == pytest.approx({k: float(round(v)) for k, v in want.items() if round(v)}, abs=1)
    before = moved(spark)
    solved = counts.solve_samples(counts.normalise_samples(table), matrix, 1e-3).collect()
    assert moved(spark) - before < 2e6
    assert {r.sample_id for r in solved} == set(samples)
    for s in samples:
        assert sum(r.f for r in solved if r.sample_id == s) == pytest.approx(1)
