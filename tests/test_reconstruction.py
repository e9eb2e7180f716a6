"""Expected values of the reconstruction's operators; sequences and results in them are fixed values."""

import numpy as np
import pytest
from fixtures import REGIONS, THREE_DATABASE, THREE_SUMMARY, three_regions, two_regions
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.operators import align, counts, database, extract, fragments, taxonomy, trim
from strandloom.plans import reconstruction


def seqs(spark, **kw):
    return spark.createDataFrame(list(kw.items()), schemas.SEQUENCES)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


REGION1 = {"seq1": "GCGAAGCGGCTCAGG", "seq2": "GCGAAGCGGCTCAGG", "seq3": "WTCCGCGTTGGAGTT", "seq5": "CGTTTATGTATGCCC", "seq6": "CGTTTATGTATGCCT"}


def test_extract_forward(spark):
    kmers, found = extract.prepare_extracted_region(seqs(spark, **REGION1), "Bludhaven", 15, "WANTCAT", "CATCATCAT")
    assert pairs(kmers, "id", "sequence") == [
        ("seq1|seq2", "GCGAAGCGGCTCAGG"), ("seq3@0001", "ATCCGCGTTGGAGTT"), ("seq3@0002", "TTCCGCGTTGGAGTT"), ("seq5", "CGTTTATGTATGCCC"), ("seq6", "CGTTTATGTATGCCT"),
    ]
    maps, _, _ = two_regions(spark)
    assert sorted(map(tuple, found.select(*schemas.KMER_MAP.names).collect())) == sorted(map(tuple, maps[0].collect()))


def test_extract_suffix_reversed(spark):
    kmers, found = extract.prepare_extracted_region(seqs(spark, **REGION1), "r", -5, "WANTCAT", "CATCATCAT", reverse_complement_result=True)
    assert pairs(kmers, "id", "sequence") == [("seq1|seq2", "CCTGA"), ("seq3@0001", "AACTC"), ("seq5", "GGGCA"), ("seq6", "AGGCA")]
    assert {r.kmer_length for r in found.collect()} == {-5}


def test_extract_whole_and_short(spark):
    kmers, _ = extract.prepare_extracted_region(seqs(spark, a="ACGT", b="AC", c="ACGT"), "r", 0, "A", "A")
    assert pairs(kmers, "id", "sequence") == [("a|c", "ACGT"), ("b", "AC")]
    kmers, _ = extract.prepare_extracted_region(seqs(spark, a="ACGT", b="AC"), "r", 3, "A", "A")
    assert pairs(kmers, "id", "sequence") == [("a", "ACG")]
    assert pairs(extract.cull_degenerates(seqs(spark, a="ANNN", b="ACGN"), 1), "id") == [("b",)]


READS = {"asv01": "GCGAAGCGGCTCAGG", "asv02": "ATCCGCGTTGGAGTT", "asv03": "TTCCGCGTTGGAGTT", "asv04": "CGTTTATGTATGCCC", "asv05": "CGTTTATGTATGCCT"}
KMERS = {"seq1|seq2": "GCGAAGCGGCTCAGG", "seq3@0001": "ATCCGCGTTGGAGTT", "seq3@0002": "TTCCGCGTTGGAGTT", "seq5": "CGTTTATGTATGCCC", "seq6": "CGTTTATGTATGCCT"}


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_align(spark, most):
    reads = READS | {"asv99": "A" * 15}
    found = align.align_regional_kmers(seqs(spark, **KMERS), seqs(spark, **reads), "Bludhaven", most)
    want = [(k, a, 15, n, most, "Bludhaven") for k, x in KMERS.items() for a, y in reads.items() if (n := sum(c != d for c, d in zip(x, y, strict=True))) <= most]
    assert pairs(found, *schemas.KMER_ALIGNMENT.names) == sorted(want)
    if most == 2:
        assert len(want) == 9
        assert pairs(align.unaligned_reads(found, seqs(spark, **reads)), "id") == [("asv99",)]


def test_align_bounds(spark):
    short = {"a": "AC", "b": "GT"}
    assert align.align_regional_kmers(seqs(spark, **short), seqs(spark, **short), "r", 2).count() == 4
    with pytest.raises(ValueError):
        align.align_regional_kmers(seqs(spark, a="ACG"), seqs(spark, b="AC"), "r")
    with pytest.raises(ValueError):
        align.align_regional_kmers(seqs(spark, a="ACG", b="AC"), seqs(spark, b="ACG"), "r")


def test_database_three_regions(spark):
    maps, aligned = three_regions(spark)
    found, summary = database.reconstruct_database(["0", "1", "2"], aligned, maps)
    assert pairs(found, *schemas.DATABASE_MAP.names) == THREE_DATABASE
    got = pairs(summary, *schemas.SUMMARY.names)
    assert [(*r[:4], round(r[4], 6), r[5]) for r in got] == sorted(THREE_SUMMARY)


def test_database_two_regions_without_variants(spark):
    maps, aligned, _ = two_regions(spark)
    _, summary = database.reconstruct_database(REGIONS, aligned, maps, count_degenerates=False)
    assert {r.feature_id: r.total_kmers_mapped for r in summary.collect()} == {"seq1": 2, "seq2": 2, "seq3": 2, "seq4": 1, "seq5": 2, "seq6": 2}


def test_database_ids_with_dashes(spark):
    maps, aligned, _ = two_regions(spark)
    dash = [m.withColumns({c: F.replace(F.col(c), F.lit("seq"), F.lit("se-q-")) for c in ("db_seq", "seq_name", "kmer")}) for m in maps]
    also = [a.withColumn("kmer", F.replace("kmer", F.lit("seq"), F.lit("se-q-"))) for a in aligned]
    found, _ = database.reconstruct_database(REGIONS, also, dash)
    assert pairs(found, "db_seq", "clean_name") == [(f"se-q-{k}", f"se-q-{k}") for k in range(1, 7)]


def test_detangle(spark):
    sets = {
        "00": "00 02", "01": "01 02", "02": "00 01 02", "03": "03 04", "04": "03 04 05", "05": "04 05", "06": "06", "07": "07 08", "08": "07 08",
        "10": "10 12 13 14", "11": "11 12 13 14 15", "12": "10 11 12 13 14", "13": "10 11 12 13 14", "14": "10 11 12 13 14", "15": "11 15",
    }
    edges = spark.createDataFrame([(i, j) for i, js in sets.items() for j in js.split()], "i string, j string")
    merged = {"07": "07|08", "08": "07|08", "12": "12|13|14", "13": "12|13|14", "14": "12|13|14"}
    assert pairs(database.detangle(edges), "db_seq", "clean_name") == sorted((i, merged.get(i, i)) for i in sets)


def test_detangling_groups_equals_detangling_edges(spark):
    rng = np.random.default_rng(3)
    for seed in range(3):
        sigs = [f"g{rng.integers(0, 6)}" for _ in range(14)]
        owners = [(f"s{k:02}", s) for k, s in enumerate(sigs)]
        sets = {(s, f"s{k:02}") for s in set(sigs) for k in range(14) if rng.random() < 0.3}
        if seed:  # all in their own sets
            sets |= {(s, i) for i, s in owners}
        edges = {(i, j) for i, s in owners for t, j in sets if s == t} | {(i, i) for i, _ in owners}
        want = pairs(database.detangle(spark.createDataFrame(sorted(edges), "i string, j string")), "db_seq", "clean_name")
        found = database.detangle_groups(spark.createDataFrame(owners, "db_seq string, sig string"), spark.createDataFrame(sorted(sets), "sig string, j string"))
        assert pairs(found, "db_seq", "clean_name") == want


@pytest.mark.parametrize(("strict", "want"), [(False, ["a|b", "a|b", "c", "d", "t"]), (True, ["a|b", "a|b", "c|d", "c|d", "t"])])
def test_second_round(spark, strict, want):
    sets = {"t": "t", "a": "a b t", "b": "a b t", "c": "a b c d t", "d": "c d t"}
    rows = [(i, i, "|".join(js.split()), 0) for i, js in sets.items()]
    kmers = spark.createDataFrame(rows, "db_seq string, seq_name string, kmer string, region int")
    assert [r[1] for r in pairs(database.solve_names(kmers, strict), "db_seq", "clean_name")] == want


WANT = {
    "average": [[100, 50, 0, 50, 50, 50], [100, 25, 100, 25, 25, 25], [0, 100, 100, 0, 50, 50]],
    "unweighted": [[200, 100, 0, 50, 100, 100], [200, 50, 200, 25, 50, 50], [0, 200, 200, 0, 100, 100]],
    "weighted": [[200, 100, 0, 100, 100, 100], [200, 50, 200, 50, 50, 50], [0, 200, 200, 0, 100, 100]],
}


@pytest.mark.parametrize("how", ["average", "unweighted"])
def test_counts(spark, how):
    maps, aligned, tables = two_regions(spark)
    names, summary = database.reconstruct_database(REGIONS, aligned, maps)
    found = counts.reconstruct_counts(REGIONS, aligned, tables, names, summary, min_abund=1e-2, min_counts=10, region_normalize=how)
    want = [(f"seq{k}", f"sample{s}", float(n)) for s, row in enumerate(WANT[how], 1) for k, n in enumerate(row, 1) if n]
    assert pairs(found, "feature_id", "sample_id", "count") == sorted(want)


def test_counts_too_shallow(spark):
    maps, aligned, tables = two_regions(spark)
    names, summary = database.reconstruct_database(REGIONS, aligned, maps)
    with pytest.raises(ValueError, match="There are 2 samples with fewer than 590 total sequences"):
        counts.reconstruct_counts(REGIONS, aligned, tables, names, summary, min_counts=590)
    with pytest.raises(KeyError):
        counts.reconstruct_counts(REGIONS, aligned, tables, names.where("db_seq <> 'seq4'"), summary, min_counts=10)
    with pytest.raises(ValueError):
        counts.reconstruct_counts(REGIONS, aligned, tables, names, summary, region_normalize="other")


def test_scale_counts(spark):
    matrix = spark.createDataFrame([("r1", "s1", 0.5), ("r2", "s1", 0.5)], "asv string, clean_name string, a double")
    shares = spark.createDataFrame([("x", "s1", 1.0)], "sample_id string, clean_name string, f double")
    table = spark.createDataFrame([("r1", "x", 10.0), ("r2", "x", 15.0)], schemas.FEATURE_TABLE)
    summary = spark.createDataFrame([("s1", 2)], "feature_id string, num_regions int")
    got = {how: counts.scale_counts(table, shares, matrix, summary, how, 4).first()["count"] for how in counts.NORMALISE}
    assert got == {"average": 12.0, "weighted": 50.0, "unweighted": 25.0}  # 12.5 is rounded to even


def test_error_model(spark):
    aligned = spark.createDataFrame([("a", "x", 15, 1, 2, "r"), ("a@0002", "x", 15, 0, 2, "r")], schemas.KMER_ALIGNMENT)
    names = spark.createDataFrame([("a", "a")], "db_seq string, clean_name string")
    summary = spark.createDataFrame([("a", 2)], "feature_id string, num_regions int")
    r = counts.alignment_matrix(aligned, names, summary).collect()
    assert len(r) == 1
    assert r[0].mismatch == 0
    assert r[0].match_prob == pytest.approx(0.995**15)
    assert r[0].max_error_prob == pytest.approx(0.995**13 * (0.005 / 3) ** 2)
    assert r[0].error_thresh == pytest.approx(0.995**15 - 0.1 * 0.995**13 * (0.005 / 3) ** 2)
    assert r[0].perf_match
    assert r[0].norm == pytest.approx(0.995**15 / 2)


def test_em_one_sample():
    h, low = 0.4638, 0.0008
    dense = np.zeros((10, 6))
    for row, column, v in [(0, 0, h), (0, 1, h), (1, 2, h), (2, 4, h), (2, 5, low), (3, 4, low), (3, 5, h), (4, 0, h), (5, 1, h), (6, 2, h), (7, 3, 2 * h), (8, 4, h), (9, 5, h)]:
        dense[row, column] = v
    row, column = np.nonzero(dense)
    y = np.array([0.18181818] + [0.09090909] * 9)
    f = counts.solve_em(row, column, dense[row, column], y, 1e-5)
    assert f.round(4).tolist() == [0.1818, 0.1818, 0.1818, 0.0909, 0.1818, 0.1818]
    with pytest.raises(ValueError):
        counts.solve_em(row, column, dense[row, column], y, 0.99)


# Taxonomies, and what each (define_missing, ambiguity_handling) makes of them, a line for each group.
# fmt: off
GROUPS = [["seq01"], ["seq03", "seq04"], ["seq06", "seq07"], ["seq08", "seq09", "seq10"], ["seq12"], ["seq13", "seq14"]]
GREENGENES = {
    "seq01": "k__DCU; p__Superhero; c__Gotham; o__Civillian; f__; g__; s__",
    "seq03": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batgirl; g__Gordon; s__Barbara",
    "seq04": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batgirl; g__Gordon; s__Barbara",
    "seq06": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Oracle; g__Gordon; s__",
    "seq07": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Oracle; g__; s__",
    "seq08": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batman; g__; s__",
    "seq09": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batman; g__Wayne; s__Bruce",
    "seq10": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batman; g__Grayson; s__",
    "seq12": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Grayson; s__Dick",
    "seq13": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Todd; s__",
    "seq14": "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Drake; s__",
}
GREENGENES_WANT = {
    ("ignore", "ignore"): [
        "k__DCU; p__Superhero; c__Gotham; o__Civillian; f__; g__; s__",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batgirl; g__Gordon; s__Barbara",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Oracle; g__|g__Gordon; g__|g__Gordon",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batman; g__|g__Grayson|g__Wayne; g__|g__Grayson|g__Wayne",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Grayson; s__Dick",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Drake|g__Todd; g__Drake|g__Todd",
    ],
    ("inherit", "missing"): [
        "k__DCU; p__Superhero; c__Gotham; o__Civillian; o__Civillian; o__Civillian; o__Civillian",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batgirl; g__Gordon; s__Barbara",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Oracle; f__Oracle|g__Gordon; f__Oracle|g__Gordon",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batman; f__Batman|g__Grayson|g__Wayne; f__Batman|g__Grayson|g__Wayne",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Grayson; s__Dick",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Drake|g__Todd; g__Drake|g__Todd",
    ],
    ("merge", "ignore"): [
        "k__DCU; p__Superhero; c__Gotham; o__Civillian; o__Civillian; o__Civillian; o__Civillian",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batgirl; g__Gordon; s__Barbara",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Oracle; g__Gordon; g__Gordon",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Batman; g__Grayson|g__Wayne; g__Grayson|g__Wayne",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Grayson; s__Dick",
        "k__DCU; p__Superhero; c__Gotham; o__Batfamily; f__Robin; g__Drake|g__Todd; g__Drake|g__Todd",
    ],
}
SILVA = {
    "seq01": "DCU;Superhero;Civillian;ambigious;ambigious;ambigious",
    "seq03": "DCU;Superhero;Bat;Batgirl;Gordon;Barbara",
    "seq04": "DCU;Superhero;Bat;Batgirl;Gordon;Barbara",
    "seq06": "DCU;Superhero;Bat;Oracle;Gordon;bat_metagenome",
    "seq07": "DCU;Superhero;Bat;Oracle;bat_metagenome;bat_metagenome",
    "seq08": "DCU;Superhero;Bat;Batman;ambigious;ambigious",
    "seq09": "DCU;Superhero;Bat;Batman;Wayne;Bruce",
    "seq10": "DCU;Superhero;Bat;Batman;Grayson;ambigious",
    "seq12": "DCU;Superhero;Bat;Robin;Grayson;Dick",
    "seq13": "DCU;Superhero;Bat;Robin;Todd;uncultured",
    "seq14": "DCU;Superhero;Bat;Robin;Drake;uncultured",
}
SILVA_WANT = {
    ("ignore", "ignore"): [
        "DCU;Superhero;Civillian;ambigious;ambigious;ambigious",
        "DCU;Superhero;Bat;Batgirl;Gordon;Barbara",
        "DCU;Superhero;Bat;Oracle;Gordon|bat_metagenome;Gordon|bat_metagenome",
        "DCU;Superhero;Bat;Batman;Grayson|Wayne|ambigious;Grayson|Wayne|ambigious",
        "DCU;Superhero;Bat;Robin;Grayson;Dick",
        "DCU;Superhero;Bat;Robin;Drake|Todd;Drake|Todd",
    ],
    ("inherit", "missing"): [
        "DCU;Superhero;Civillian;Civillian;Civillian;Civillian",
        "DCU;Superhero;Bat;Batgirl;Gordon;Barbara",
        "DCU;Superhero;Bat;Oracle;Gordon|Oracle;Gordon|Oracle",
        "DCU;Superhero;Bat;Batman;Batman|Grayson|Wayne;Batman|Grayson|Wayne",
        "DCU;Superhero;Bat;Robin;Grayson;Dick",
        "DCU;Superhero;Bat;Robin;Drake|Todd;Drake|Todd",
    ],
    ("merge", "ignore"): [
        "DCU;Superhero;Civillian;ambigious;ambigious;ambigious",
        "DCU;Superhero;Bat;Batgirl;Gordon;Barbara",
        "DCU;Superhero;Bat;Oracle;Gordon;Gordon",
        "DCU;Superhero;Bat;Batman;Grayson|Wayne|ambigious;Grayson|Wayne|ambigious",
        "DCU;Superhero;Bat;Robin;Grayson;Dick",
        "DCU;Superhero;Bat;Robin;Drake|Todd;Drake|Todd",
    ],
}
# fmt: on


def taxa_map(spark):
    return spark.createDataFrame([(s, "|".join(g)) for g in GROUPS for s in g], "db_seq string, clean_name string")


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize(("database", "taxa", "how", "want"), [("greengenes", GREENGENES, *x) for x in GREENGENES_WANT.items()] + [("silva", SILVA, *x) for x in SILVA_WANT.items()])
def test_taxonomy(spark, database, taxa, how, want):
    found = taxonomy.reconstruct_taxonomy(taxa_map(spark), spark.createDataFrame(list(taxa.items()), schemas.TAXONOMY), database, *how)
    assert pairs(found, "feature_id", "taxon") == [("|".join(g), w) for g, w in zip(GROUPS, want, strict=True)]


def test_taxonomy_warnings_and_errors(spark):
    one = spark.createDataFrame([("a", "a")], "db_seq string, clean_name string")
    taxa = spark.createDataFrame([("a", "k__x;p__y")], schemas.TAXONOMY)
    with pytest.warns(UserWarning) as told:
        taxonomy.reconstruct_taxonomy(one, taxa, "none", "merge", "missing")
    assert sum("ignored by default" in str(w.message) for w in told) == 2
    with pytest.raises(ValueError, match="Only one taxonomic level"):
        taxonomy.reconstruct_taxonomy(one, taxa, "greengenes")
    with pytest.raises(TypeError):
        taxonomy.reconstruct_taxonomy(one, taxa, "other")
    with pytest.raises(KeyError):
        taxonomy.reconstruct_taxonomy(one.union(spark.createDataFrame([("b", "b")])), taxa, "silva")
    ragged = taxa.union(spark.createDataFrame([("b", "k__x;p__y;c__z")]))
    with pytest.raises(ValueError, match="levels"):
        taxonomy.reconstruct_taxonomy(one.union(spark.createDataFrame([("b", "b")])), ragged, "silva")


def test_trim(spark):
    _, _, tables = two_regions(spark)
    table, out = trim.trim_dada2_posthoc(tables[0], seqs(spark, **READS), 5)
    ids = {"GCGAA": "21f1ded98563f87f5699c8aae7e1639e", "ATCCG": "17e8ebf20d380363085629b22ea39722", "TTCCG": "57a67d2f8243b5c4573798582153bd48", "CGTTT": "74f4d3364948ee9313062e0f0b43a5e9"}
    assert pairs(out, "sequence", "id") == sorted(ids.items())
    want = {"sample1": [150, 0, 0, 100], "sample2": [125, 50, 50, 50], "sample3": [100, 0, 100, 100]}
    assert pairs(table, "sample_id", "feature_id", "count") == sorted((s, i, float(n)) for s, ns in want.items() for i, n in zip(ids.values(), ns, strict=True) if n)
    table, out = trim.trim_dada2_posthoc(tables[0], seqs(spark, **READS), 0, hashed_feature_ids=False)
    assert pairs(out, "id", "sequence") == sorted((s, s) for s in READS.values())
    with pytest.warns(UserWarning, match="shorter"):
        table, out = trim.trim_dada2_posthoc(tables[0], seqs(spark, asv01="ACGTA", asv02="AC"), 4)
    assert pairs(out, "sequence") == [("ACGT",)]
    assert table.agg(F.sum("count")).first()[0] == 375


MSA = {
    "seq01": "-CTAGTCATGCGAAGCGGCTCAGGATGATGATGAAGAC---------------------------------",
    "seq02": "ACTAGTCATGCGAAGCGGCTCAGGATGATGATGAAGAC---------------------------------",
    "seq03": "CATAGTCATWTCCGCGTTGGAGTTATGATGATGAWACCACCTCGTCCCAGTTCCGCGCTTCTGACGTGCA-",
    "seq04": "------------------GGAGTTATGATGA--AGACCACCTCGTCCCAGTTCCGCGCTTCTGACGTGCAC",
    "seq05": "CATAGTCATCGTTTATGTATGCCCATGATGATGCGAGCACCTCGTATGGATGTAGAGCCACTGACGTGCGG",
}


def fragment_inputs(spark):
    w, c = "WANTCAT", "CACCTCGTN"
    rows = [("seq01", "seq01|seq02", 0, w, 0, w, 15), ("seq02", "seq01|seq02", 0, w, 0, w, 15), ("seq03", "seq03|seq04", 0, w, 1, c, 15), ("seq04", "seq03|seq04", 0, c, 1, c, 15), ("seq05", "seq05", 0, w, 1, c, 15)]
    summary = [(n, 1, 1, 1.0, 0.0, "") for n in ("seq01|seq02", "seq03|seq04", "seq05")]
    return spark.createDataFrame(rows, schemas.DATABASE_MAP), spark.createDataFrame(summary, schemas.SUMMARY), seqs(spark, **MSA)


def test_fragments(spark, tmp_path):
    names, summary, msa = fragment_inputs(spark)
    found = reconstruction.reconstruct_tree(names, summary, msa, str(tmp_path / "f.fasta"))
    want = [("seq01|seq02", "GCGAAGCGGCTCAGG"), ("seq03|seq04", "WTCCGCGTTGGAGTTATGATGATGAGACCACCTCGTCCCAGTTCCGCGCTTC")]
    assert pairs(found, "id", "sequence") == want
    assert pairs(fragments.reconstruct_fragment_rep_seqs(names.where("clean_name = 'seq05'"), summary.where("feature_id = 'seq05'"), msa), "id", "sequence") == [("1", "ATCG")]
    with pytest.raises(KeyError):
        fragments.reconstruct_fragment_rep_seqs(names, summary, msa.where("id <> 'seq01'"))


def test_fragments_fuzzy(spark):
    names, summary, msa = fragment_inputs(spark)
    names = names.withColumn("first_fwd_primer", F.when(F.col("first_fwd_primer") == "WANTCAT", "WANTCGT").otherwise(F.col("first_fwd_primer"))).withColumn("last_fwd_primer", F.when(F.col("last_fwd_primer") == "WANTCAT", "WANTCGT").otherwise(F.col("last_fwd_primer")))
    assert pairs(fragments.reconstruct_fragment_rep_seqs(names, summary, msa), "id", "sequence")[0] == ("seq01|seq02", "GCGAAGCGGCTCAGG")


def test_pipeline_matches_its_steps(spark):
    maps, aligned, tables = two_regions(spark)
    taxa = spark.createDataFrame([(f"seq{k}", f"k__x;p__{k}") for k in range(1, 7)], schemas.TAXONOMY)
    with pytest.warns(UserWarning):
        out = reconstruction.reconstruct_profiles(REGIONS, maps, aligned, tables, taxa, min_abund=1e-2, min_counts=10)
    assert out.table.count() == sum(bool(n) for row in WANT["average"] for n in row)
    assert pairs(out.taxonomy, "feature_id", "taxon") == [(f"seq{k}", f"k__x;p__{k}") for k in range(1, 7)]
    assert pairs(reconstruction.exclude_taxa(taxa, seqs(spark, seq1="A", seq2="C"), ["P__1"]), "id") == [("seq2",)]
