import pytest
from pyspark.sql import functions as F

from strandloom.functions import iupac


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_expressions(spark):
    assert one(spark, iupac.reverse_complement(F.lit("CACGTCAK"))) == "MTGACGTG"
    assert iupac.reverse_complement_text("CACGTCAK") == "MTGACGTG"
    assert one(spark, iupac.variants(F.lit("AWN"))) == sorted(a + b + c for a in "A" for b in "AT" for c in "ACGT")
    assert one(spark, iupac.variants(F.lit("ACGT"))) == ["ACGT"]
    assert one(spark, iupac.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, iupac.count_degenerates(F.lit("ANGWT"))) == 2
    assert one(spark, iupac.db_seq(F.lit("a@0001"))) == "a"
    assert one(spark, iupac.primer_pattern(F.lit("WANTCAT"))) == "[AT]A[ACGT]TCAT"
    assert iupac.primer_pattern_text("WANTCAT") == "[AT]A[ACGT]TCAT"
    assert iupac.primer_pattern_text("WANTCAT", 1) == "((?<=([AT])))((A[ACGT]TCAT){e<=1})"


@pytest.mark.parametrize(("pattern", "start", "end"), [("[AT]A[ACGT]TCAT", 2, 9), ("ATGATGATG", 24, 33), ("WANTCAT", None, None)])
def test_primer_search(spark, pattern, start, end):
    s = F.lit("-CTAGTCATGCGAAGCGGCTCAGGATGATGATGAAGAC----")
    assert (one(spark, iupac.find_start(s, F.lit(pattern))), one(spark, iupac.find_end(s, F.lit(pattern)))) == (start, end)
