import json

import pytest
from fixtures import counts, two_regions

from strandloom import schemas, sources


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text(">b second\nACGT\nAC\n>a\nGG\n\n")
    found = sources.read_fasta(spark, str(path))
    assert sorted(map(tuple, found.collect())) == [("a", "GG"), ("b", "ACGTAC")]
    sources.write_fasta(found, str(tmp_path / "out"), single_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == ">a\nGG\n>b\nACGTAC\n"
    assert sources.read_fasta(spark, str(tmp_path / "out")).count() == 2


def test_fasta_signs_within_headers(spark, tmp_path):
    (tmp_path / "in.fasta").write_bytes(b">s1 5'->3' strand\r\nAC\r\nGT\r\n>empty\r\n>s2 > >\r\nGG\r\n")
    (tmp_path / "more.fasta").write_text(">s3\nA>C\n")
    found = sources.read_fasta(spark, str(tmp_path / "*.fasta"))
    assert sorted(map(tuple, found.collect())) == [("empty", ""), ("s1", "ACGT"), ("s2", "GG"), ("s3", "A>C")]


def test_tables_round_trip(spark, tmp_path):
    maps, aligned, _ = two_regions(spark)
    for kind, df in (("kmer-map", maps[0]), ("kmer-align", aligned[0])):
        path = str(tmp_path / kind)
        sources.write_table(df, path, single_file=True)
        back = sources.read_table(spark, path, kind, validate=True)
        assert back.schema == df.schema
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [r.id for r in sources.with_row_id(maps[0], ["db_seq", "seq_name"]).orderBy("db_seq", "seq_name").collect()] == list("012345")


def test_validation(spark, tmp_path):
    head = "db-seq\tseq-name\tkmer\tregion\tfwd-primer\trev-primer\tkmer-length\n"
    for name, text, why in (("columns", head.replace("db-seq", "db_seq"), "correct columns"), ("number", head + "a\ta\ta\tr\tA\tC\t50ish\n", "numeric")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=why):
            sources.validate_table(spark, str(tmp_path / name), "kmer-map")


def test_summary_and_old_map(spark, tmp_path):
    (tmp_path / "s").write_text("feature-id\tnum-regions\ttotal-kmers-mapped\tmean-kmer-per-region\tstdv-kmer-per-region\tmapped-asvs\n#q2:types\tnumeric\tnumeric\tnumeric\tnumeric\tcategorical\nseq1\t2.0\t3\t1.5\t0.5\tasv1|asv2\n")
    assert [tuple(r) for r in sources.read_table(spark, str(tmp_path / "s"), "sidle-summary", True).collect()] == [("seq1", 2, 3, 1.5, 0.5, "asv1|asv2")]
    path = str(tmp_path / "out")
    sources.write_table(sources.read_table(spark, str(tmp_path / "s"), "sidle-summary"), path, single_file=True)
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert lines == ["feature-id\tnum-regions\ttotal-kmers-mapped\tmean-kmer-per-region\tstdv-kmer-per-region\tmapped-asvs", "#q2:types\tnumeric\tnumeric\tnumeric\tnumeric\tcategorical", "seq1\t2\t3\t1.5\t0.5\tasv1|asv2"]
    assert [tuple(r) for r in sources.read_table(spark, path, "sidle-summary", True).collect()] == [("seq1", 2, 3, 1.5, 0.5, "asv1|asv2")]
    (tmp_path / "m").write_text("db-seq\tclean_name\tlength-solo\tfwd-primer\nseq1\tseq1\t15\tWANTCAT\n")
    found = sources.read_table(spark, str(tmp_path / "m"), "sidle-reconstruction-mapping", True)
    assert [tuple(r) for r in found.collect()] == [("seq1", "seq1", 15.0, "WANTCAT")]
    assert found.columns == ["db_seq", "clean_name", "length_solo", "fwd_primer"]


def test_feature_tables(spark, tmp_path):
    table = counts(spark, "a b", [[1, 0], [2.5, 3]])
    want = sorted(map(tuple, table.collect()))
    sources.write_feature_tsv(table, str(tmp_path / "t"))
    assert sorted(map(tuple, sources.read_feature_tsv(spark, str(tmp_path / "t")).collect())) == want
    sources.write_biom_json(table, str(tmp_path / "b"))
    assert sorted(map(tuple, sources.read_biom_json(spark, str(tmp_path / "b")).collect())) == want
    text = next((tmp_path / "b").glob("part-*")).read_text()
    doc = json.loads(text)
    assert [x["id"] for x in doc["rows"]] == ["a", "b"] and [x["id"] for x in doc["columns"]] == ["sample1", "sample2"]
    assert (doc["shape"], doc["data"]) == ([2, 2], [[0, 0, 1.0], [0, 1, 2.5], [1, 1, 3.0]])
    lines = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert lines == ["#OTU ID\tsample1\tsample2", "a\t1.0\t2.5", "b\t0.0\t3.0"]
    sources.write_biom_json(table.limit(0), str(tmp_path / "none"))
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text())["data"] == []
    dense = {"matrix_type": "dense", "rows": [{"id": "a"}], "columns": [{"id": "x"}, {"id": "y"}], "data": [[0, 2]]}
    (tmp_path / "d").write_text(json.dumps(dense))
    found = sources.read_biom_json(spark, str(tmp_path / "d"))
    assert [tuple(r) for r in found.collect()] == [("a", "y", 2.0)]
    assert found.columns == schemas.FEATURE_TABLE.names
