"""Queries over the driver's tables, one for each operator, with their SQL.

The tables hold no nucleotides, so sequences are the hexadecimal digits of each
text's md5, translated to letters; both engines agree on them. Queries run over
their whole tables. In ``align_kmers`` and ``unaligned_reads`` even documents are
kmers and odd ones reads (``align_long_kmers`` has all on both sides); of ``two_regions``
the second lacks every third sequence, as a region may.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import sources
from strandloom.functions import iupac
from strandloom.operators import align, counts, database, extract, fragments, taxonomy, trim
from strandloom.plans import reconstruction
from strandloom.store import new_path, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "reconstruct_counts"

HEX = "0123456789abcdef"
PLAIN = "ACGT" * 4
#: With degenerate codes, and with gaps.
CODED, GAPPED = "ACGTACGTACGTACWN", "ACGTACGTACGT----"
REGIONS = ["A", "B"]
FWD, REV = {"A": "WANTCAT", "B": "CACCTCGTN"}, {"A": "CATCATCAT", "B": "CACGTCAK"}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, n: int, letters: str = PLAIN, where: str = "true") -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(where)
    name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))
    return docs.select(name.alias("id"), F.translate(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, n), HEX, letters).alias("sequence"))


def sequences_sql(n: int, letters: str = PLAIN, where: str = "true") -> str:
    return f"SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS id, translate(substr(md5(coalesce(text, '')), 1, {n}), '{HEX}', '{letters}') AS sequence FROM documents WHERE {where}"


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table from the orders: parts as features, suppliers in samples."""
    rows = read(spark, sf_dir, "lineitem")
    feature = F.concat(F.lit("d"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    sample = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    return rows.groupBy(feature.alias("feature_id"), sample.alias("sample_id")).agg(F.sum("l_quantity").alias("count"))


ORDER_COUNTS = "SELECT 'd' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS feature_id, 's' || CAST(l_suppkey % 5 AS VARCHAR) AS sample_id, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2"


# Trimming, nucleotide functions


@query(f"""WITH r AS ({sequences_sql(12)}), t AS ({ORDER_COUNTS})
SELECT md5(substr(r.sequence, 1, 5)) AS feature_id, t.sample_id, sum(t.count) AS count FROM t JOIN r ON t.feature_id = r.id GROUP BY 1, 2""")
def trim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim_dada2_posthoc(order_counts(spark, sf_dir), sequences(spark, sf_dir, 12), 5)[0]


@query(f"SELECT DISTINCT sequence AS id, sequence FROM ({sequences_sql(12)})")
def trim_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim_dada2_posthoc(order_counts(spark, sf_dir), sequences(spark, sf_dir, 12), 0, hashed_feature_ids=False)[1]


@query(f"SELECT id, reverse(translate(sequence, '{iupac.COMPLEMENT[0]}', '{iupac.COMPLEMENT[1]}')) AS sequence FROM ({sequences_sql(32, CODED)})")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, 32, CODED).select("id", iupac.reverse_complement("sequence").alias("sequence"))


@query(f"SELECT id, CAST(length(regexp_replace(sequence, '[ACGT]', '', 'g')) AS INTEGER) AS n FROM ({sequences_sql(32, CODED)})")
def degenerate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, 32, CODED).select("id", iupac.count_degenerates("sequence").alias("n"))


@query(f"SELECT id, sequence FROM ({sequences_sql(32, CODED)}) WHERE length(regexp_replace(sequence, '[ACGT]', '', 'g')) <= 3")
def cull_degenerates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.cull_degenerates(sequences(spark, sf_dir, 32, CODED), 3)


@query(f"""WITH s AS ({sequences_sql(32)}), x AS (SELECT id, sequence, regexp_extract(sequence, '[AT]A[ACGT]T') AS m FROM s)
SELECT id, CAST(CASE WHEN m <> '' THEN strpos(sequence, m) - 1 ELSE -1 END AS INTEGER) AS p_start, CAST(CASE WHEN m <> '' THEN strpos(sequence, m) - 1 + length(m) ELSE -1 END AS INTEGER) AS p_end FROM x""")
def primer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a primer's first match; -1 where it has none."""
    pattern = iupac.primer_pattern(F.lit("WANT"))
    s = sequences(spark, sf_dir, 32)
    return s.select("id", F.coalesce(iupac.find_start(F.col("sequence"), pattern), F.lit(-1)).alias("p_start"), F.coalesce(iupac.find_end(F.col("sequence"), pattern), F.lit(-1)).alias("p_end"))


# Extraction

EXPANDED = f"""RECURSIVE s AS ({sequences_sql(6, CODED)}),
e AS (SELECT id, sequence, 0 AS k, '' AS v FROM s UNION ALL
      SELECT id, sequence, k + 1, v || unnest(CASE substr(sequence, k + 1, 1) WHEN 'W' THEN ['A', 'T'] WHEN 'N' THEN ['A', 'C', 'G', 'T'] ELSE [substr(sequence, k + 1, 1)] END) FROM e WHERE k < 6),
n AS (SELECT id AS db_seq, v AS sequence, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY v) AS r FROM e WHERE k = 6),
x AS (SELECT db_seq, CASE WHEN n > 1 THEN db_seq || '@' || lpad(CAST(r AS VARCHAR), 4, '0') ELSE db_seq END AS seq_name, sequence FROM n),
t AS (SELECT db_seq, substr(sequence, 1, 5) AS amplicon, min(seq_name) AS seq_name FROM x GROUP BY 1, 2),
c AS (SELECT amplicon, string_agg(seq_name, '|' ORDER BY seq_name) AS kmer FROM t GROUP BY 1)"""


@query(f"WITH {EXPANDED} SELECT db_seq, seq_name, sequence FROM x")
def expand_degenerates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.expand_degenerates(sequences(spark, sf_dir, 6, CODED))


def coded_region(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return extract.prepare_extracted_region(sequences(spark, sf_dir, 6, CODED), "A", 5, FWD["A"], REV["A"])


@query(f"WITH {EXPANDED} SELECT kmer AS id, amplicon AS sequence FROM c")
def extract_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_region(spark, sf_dir)[0]


MAP_SQL = f"WITH {EXPANDED} SELECT t.db_seq, t.seq_name, c.kmer, 'A' AS region, '{FWD['A']}' AS fwd_primer, '{iupac.reverse_complement_text(REV['A'])}' AS rev_primer, 5 AS kmer_length FROM t JOIN c ON t.amplicon = c.amplicon"


@query(MAP_SQL)
def extract_kmer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_region(spark, sf_dir)[1]


@query(f"""SELECT string_agg(id, '|' ORDER BY id) AS id, reverse(translate(amplicon, 'ACGT', 'TGCA')) AS sequence FROM (SELECT id, right(sequence, 5) AS amplicon FROM ({sequences_sql(9)})) GROUP BY amplicon""")
def extract_suffix_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prepare_extracted_region(sequences(spark, sf_dir, 9), "A", -5, FWD["A"], REV["A"], reverse_complement_result=True)[0]


# Alignment

READS8 = f"SELECT DISTINCT 'r' || sequence AS id, sequence FROM ({sequences_sql(8, where='doc_id % 2 = 1')})"
KMERS8 = f"SELECT string_agg(id, '|' ORDER BY id) AS id, sequence FROM ({sequences_sql(8, where='doc_id % 2 = 0')}) GROUP BY sequence"


def reads8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir, 8, where="doc_id % 2 = 1").select("sequence").distinct()
    return s.select(F.concat(F.lit("r"), "sequence").alias("id"), "sequence")


def kmers8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prepare_extracted_region(sequences(spark, sf_dir, 8, where="doc_id % 2 = 0"), "A", 8, FWD["A"], REV["A"])[0]


ALIGNED8 = f"WITH k AS ({KMERS8}), r AS ({READS8}) SELECT k.id AS kmer, r.id AS asv, 8 AS length, CAST(hamming(k.sequence, r.sequence) AS INTEGER) AS mismatch, 2 AS max_mismatch, 'A' AS region FROM k, r WHERE hamming(k.sequence, r.sequence) <= 2"


@query(ALIGNED8)
def align_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_regional_kmers(kmers8(spark, sf_dir), reads8(spark, sf_dir), "A", 2)


@query(f"WITH k AS ({KMERS8}), r AS ({READS8}) SELECT r.id, r.sequence FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE hamming(k.sequence, r.sequence) <= 1)")
def unaligned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads8(spark, sf_dir)
    return align.unaligned_reads(align.align_regional_kmers(kmers8(spark, sf_dir), reads, "A", 1), reads)


#: A stretch of 100 letters of each text's digests, and reads that differ from some of them in two places.
LONG = "translate(md5(coalesce(text, '')) || md5('1' || coalesce(text, '')) || md5('2' || coalesce(text, '')) || md5('3' || coalesce(text, '')), '" + HEX + "', '" + PLAIN + "')"
LONG_SQL = f"""k AS (SELECT string_agg(id, '|' ORDER BY id) AS id, sequence FROM (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS id, substr({LONG}, 1, 100) AS sequence FROM documents) GROUP BY sequence),
r AS (SELECT DISTINCT 'r' || md5(sequence) AS id, sequence FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN s ELSE substr(s, 1, 30) || 'AA' || substr(s, 33) END AS sequence FROM (SELECT doc_id, substr({LONG}, 1, 100) AS s FROM documents)))"""


def long_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digits = F.concat(F.md5(text), *(F.md5(F.concat(F.lit(k), text)) for k in "123"))
    name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))
    return read(spark, sf_dir, "documents").select(name.alias("id"), F.translate(F.substring(digits, 1, 100), HEX, PLAIN).alias("sequence"), "doc_id")


@query(f"WITH {LONG_SQL} SELECT k.id AS kmer, r.id AS asv, 100 AS length, CAST(hamming(k.sequence, r.sequence) AS INTEGER) AS mismatch, 2 AS max_mismatch, 'A' AS region FROM k, r WHERE hamming(k.sequence, r.sequence) <= 2")
def align_long_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on both sides, 100 letters each, two mismatches."""
    s = long_sequences(spark, sf_dir)
    kmers, _ = extract.prepare_extracted_region(s.select("id", "sequence"), "A", 100, FWD["A"], REV["A"])
    cut = F.when(F.col("doc_id") % 2 == 0, F.col("sequence")).otherwise(F.concat(F.substring("sequence", 1, 30), F.lit("AA"), F.substring("sequence", 33, 68)))
    reads = s.select(cut.alias("sequence")).distinct().select(F.concat(F.lit("r"), F.md5("sequence")).alias("id"), "sequence")
    return align.align_regional_kmers(kmers, reads, "A", 2)


# The database of two regions: the first and last five letters, the second not for every third document.

B_WHERE = "doc_id % 3 <> 0"


def two_regions(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Kmer maps, alignments and feature tables of both regions."""
    # Both are read many times below.
    whole = {"A": settle(sequences(spark, sf_dir, 10)), "B": settle(sequences(spark, sf_dir, 10, where=B_WHERE))}
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("id"), (F.col("doc_id") % 4).alias("k"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("n"))
    maps, alignments, tables = [], [], []
    for region, length in (("A", 5), ("B", -5)):
        kmers, kmer_map = extract.prepare_extracted_region(whole[region], region, length, FWD[region], REV[region])
        part = F.concat(F.lit(region), extract.trimmed(F.col("sequence"), length))
        own = whole[region].select("id", part.alias("asv"))
        reads = own.where(~F.col("asv").like("BT%")).select("asv").distinct().select(F.col("asv").alias("id"), F.substring("asv", 2, 5).alias("sequence"))
        maps.append(kmer_map)
        alignments.append(align.align_regional_kmers(kmers, reads, region, 1))
        tables.append(own.join(docs, "id").groupBy(F.col("asv").alias("feature_id"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("sample_id")).agg(F.sum("n").alias("count")))
    return maps, alignments, tables


BASE = f"""p AS ({sequences_sql(10)}), pb AS ({sequences_sql(10, where=B_WHERE)}),
o AS (SELECT id, 0 AS region, left(sequence, 5) AS amp FROM p UNION ALL SELECT id, 1, right(sequence, 5) FROM pb),
c AS (SELECT region, amp, string_agg(id, '|' ORDER BY id) AS kmer FROM o GROUP BY 1, 2),
rd AS (SELECT DISTINCT region, amp, CASE region WHEN 0 THEN 'A' ELSE 'B' END || amp AS asv FROM o WHERE NOT (region = 1 AND amp LIKE 'T%')),
al AS (SELECT c.region, c.amp, c.kmer, rd.asv, CAST(hamming(c.amp, rd.amp) AS INTEGER) AS mismatch FROM c JOIN rd ON c.region = rd.region AND hamming(c.amp, rd.amp) <= 1),
ids AS (SELECT DISTINCT o.id FROM al JOIN o ON al.region = o.region AND al.amp = o.amp),
m AS (SELECT o.id, o.region, o.amp FROM o WHERE id IN (SELECT id FROM ids)),
nr AS (SELECT id, count(*) AS n FROM m GROUP BY 1),
st AS (SELECT x.id AS i, y.id AS j FROM m x JOIN m y ON x.region = y.region AND x.amp = y.amp JOIN nr ON nr.id = x.id GROUP BY 1, 2, nr.n HAVING count(*) = nr.n),
kk AS (SELECT i, string_agg(j, '|' ORDER BY j) AS k FROM st GROUP BY 1),
td AS (SELECT k FROM kk GROUP BY k HAVING string_agg(i, '|' ORDER BY i) = k),
solved AS (SELECT i AS db_seq, k AS clean_name FROM kk WHERE k IN (SELECT k FROM td)),
ed AS (SELECT i, j FROM st WHERE i NOT IN (SELECT db_seq FROM solved) AND j NOT IN (SELECT db_seq FROM solved)),
dg AS (SELECT i, count(*) AS deg FROM ed GROUP BY 1),
pn AS (SELECT ed.i, max(a.deg) - min(b.deg) + 1 AS pen FROM ed JOIN dg a ON a.i = ed.i JOIN dg b ON b.i = ed.j GROUP BY 1),
rest AS (SELECT ed.i AS db_seq, string_agg(ed.j, '|' ORDER BY ed.j) AS clean_name FROM ed JOIN pn a ON a.i = ed.i JOIN pn b ON b.i = ed.j WHERE a.pen = b.pen GROUP BY 1),
nm AS (SELECT * FROM solved UNION ALL SELECT * FROM rest)"""


def aligned_kmers(maps: list[DataFrame], alignments: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of the maps whose sequences are aligned, and the members of all kmers."""
    maps = database.numbered_maps(maps, database.region_order(REGIONS))
    return database.union_maps(maps, database.kmer_members(alignments).select("db_seq").distinct()), database.kmer_members(maps, "region")


def names_and_summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    maps, alignments, _ = two_regions(spark, sf_dir)
    return database.reconstruct_database(REGIONS, alignments, maps)


NAMED = f"""WITH {BASE} SELECT nm.db_seq, nm.clean_name, min(m.region) AS first_region, CASE min(m.region) WHEN 0 THEN '{FWD["A"]}' ELSE '{FWD["B"]}' END AS first_fwd_primer, max(m.region) AS last_region,
CASE max(m.region) WHEN 0 THEN '{FWD["A"]}' ELSE '{FWD["B"]}' END AS last_fwd_primer, CASE max(m.region) WHEN 0 THEN 5 ELSE -5 END AS last_kmer_length FROM nm JOIN m ON m.id = nm.db_seq GROUP BY 1, 2"""


@query(NAMED)
def database_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names_and_summary(spark, sf_dir)[0]


SUMMARY = """pc AS (SELECT nm.clean_name, m.region, count(DISTINCT m.id) AS n FROM nm JOIN m ON m.id = nm.db_seq GROUP BY 1, 2),
su AS (SELECT clean_name, count(*) AS num_regions, sum(n) AS total, avg(n) AS mean_n, coalesce(stddev_samp(n), 0) AS sd FROM pc GROUP BY 1),
mp AS (SELECT nm.clean_name, al.asv, min(al.region) AS region FROM al JOIN m ON m.region = al.region AND m.amp = al.amp JOIN nm ON nm.db_seq = m.id GROUP BY 1, 2),
ma AS (SELECT clean_name, string_agg(asv, '|' ORDER BY region, asv) AS mapped_asvs FROM mp GROUP BY 1)"""


SUMMED = f"""WITH {BASE}, {SUMMARY} SELECT su.clean_name AS feature_id, CAST(num_regions AS INTEGER) AS num_regions, CAST(total AS BIGINT) AS total_kmers_mapped, round(mean_n, 9) AS mean_kmer_per_region, round(sd, 9) AS stdv_kmer_per_region, mapped_asvs
FROM su LEFT JOIN ma ON su.clean_name = ma.clean_name"""


@query(SUMMED)
def database_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(names_and_summary(spark, sf_dir)[1])


def rounded(summary: DataFrame) -> DataFrame:
    return summary.withColumns({c: F.round(c, 9) for c in ("mean_kmer_per_region", "stdv_kmer_per_region")})


@query(f"WITH {BASE} SELECT i AS db_seq, j AS shared FROM st")
def shared_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps, alignments, _ = two_regions(spark, sf_dir)
    owners, sets = database.shared_sets(*aligned_kmers(maps, alignments))
    return owners.join(sets, "sig").select("db_seq", F.col("j").alias("shared"))


@query(f"WITH {BASE} SELECT db_seq, clean_name FROM solved")
def tidy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps, alignments, _ = two_regions(spark, sf_dir)
    return database.tidy_names(*map(settle, database.shared_sets(*aligned_kmers(maps, alignments))))


@query("""WITH e AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS i, CAST(l_suppkey AS VARCHAR) AS j FROM lineitem),
ed AS (SELECT i, j FROM e UNION SELECT i, i FROM e UNION SELECT j, j FROM e),
dg AS (SELECT i, count(*) AS deg FROM ed GROUP BY 1),
pn AS (SELECT ed.i, max(a.deg) - min(b.deg) + 1 AS pen FROM ed JOIN dg a ON a.i = ed.i JOIN dg b ON b.i = ed.j GROUP BY 1)
SELECT ed.i AS db_seq, string_agg(ed.j, '|' ORDER BY ed.j) AS clean_name FROM ed JOIN pn a ON a.i = ed.i JOIN pn b ON b.i = ed.j WHERE a.pen = b.pen GROUP BY 1""")
def detangle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detangling of the directed graph of parts and suppliers of all lines, keys as they are."""
    e = read(spark, sf_dir, "lineitem").selectExpr("CAST(l_partkey AS STRING) AS i", "CAST(l_suppkey AS STRING) AS j")
    return database.detangle(settle(e.union(e.selectExpr("i", "i")).union(e.selectExpr("j", "j")).distinct()))


# Counts

MATRIX = """mx AS (SELECT nm.clean_name, al.asv, al.region, min(al.mismatch) AS mm FROM al JOIN m ON m.region = al.region AND m.amp = al.amp JOIN nm ON nm.db_seq = m.id GROUP BY 1, 2, 3),
mt AS (SELECT mx.*, pow(0.995, 5 - mm) * pow(0.005 / 3, mm) AS match_prob, pow(0.995, 5) AS perfect_prob, pow(0.995, 4) * pow(0.005 / 3, 1) AS max_error_prob, su.num_regions FROM mx JOIN su ON su.clean_name = mx.clean_name),
av AS (SELECT asv, clean_name, avg(match_prob / num_regions) AS a FROM mt GROUP BY 1, 2),
tb AS (SELECT CASE o.region WHEN 0 THEN 'A' ELSE 'B' END || o.amp AS asv, 's' || CAST(d.doc_id % 4 AS VARCHAR) AS sample_id, sum(length(coalesce(d.text, ''))) AS count FROM o JOIN documents d ON o.id = 'd' || lpad(CAST(d.doc_id AS VARCHAR), 7, '0') GROUP BY 1, 2),
kp AS (SELECT * FROM tb WHERE asv IN (SELECT asv FROM al) AND count > 0)"""


def matrix_inputs(spark: SparkSession, sf_dir: str):
    maps, alignments, tables = two_regions(spark, sf_dir)
    names, summary = database.reconstruct_database(REGIONS, alignments, maps)
    return alignments[0].unionByName(alignments[1]), names, settle(summary), tables


@query(f"""WITH {BASE}, {SUMMARY}, {MATRIX} SELECT clean_name, asv, CASE region WHEN 0 THEN 'A' ELSE 'B' END AS region, 1 AS max_mismatch, mm AS mismatch, 5 AS length,
round(match_prob, 9) AS match_prob, round(perfect_prob, 9) AS perfect_prob, round(max_error_prob, 9) AS max_error_prob, round(perfect_prob - 0.1 * max_error_prob - 2.220446049250313e-16, 9) AS error_thresh,
match_prob > perfect_prob - 0.1 * max_error_prob - 2.220446049250313e-16 AS perf_match, round(match_prob / num_regions, 9) AS norm FROM mt""")
def alignment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    alignment, names, summary, _ = matrix_inputs(spark, sf_dir)
    out = counts.alignment_matrix(alignment, names, summary)
    return out.withColumns({c: F.round(c, 9) for c in ("match_prob", "perfect_prob", "max_error_prob", "error_thresh", "norm")})


@query(f"SELECT sample_id, feature_id, round(count / sum(count) OVER (PARTITION BY sample_id), 12) AS y FROM ({ORDER_COUNTS})")
def normalise_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.normalise_samples(order_counts(spark, sf_dir)).select("sample_id", "feature_id", F.round("y", 12).alias("y"))


@query(f"SELECT feature_id, sample_id, sum(count) AS count FROM (SELECT * FROM ({ORDER_COUNTS}) UNION ALL SELECT feature_id, 's0', 2 * count FROM ({ORDER_COUNTS})) GROUP BY 1, 2")
def union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_counts(spark, sf_dir)
    return counts.union_tables([t, t.select("feature_id", F.lit("s0").alias("sample_id"), (2 * F.col("count")).alias("count"))])


@query(f"""WITH {BASE}, {SUMMARY}, {MATRIX}, sh AS (SELECT sample_id, clean_name, 1.0 / count(*) OVER (PARTITION BY sample_id) AS f FROM (SELECT DISTINCT kp.sample_id, av.clean_name FROM kp JOIN av ON av.asv = kp.asv)),
q AS (SELECT kp.sample_id, kp.asv, kp.count, av.clean_name, sh.f * av.a AS p FROM kp JOIN av ON av.asv = kp.asv JOIN sh ON sh.sample_id = kp.sample_id AND sh.clean_name = av.clean_name),
v AS (SELECT clean_name, sample_id, sum(count * p / (s + 2.220446049250313e-16)) AS v FROM (SELECT *, sum(p) OVER (PARTITION BY sample_id, asv) AS s FROM q) GROUP BY 1, 2)
SELECT v.clean_name AS feature_id, v.sample_id, round_even(v * 2.0 / su.num_regions, 0) AS count FROM v JOIN su ON su.clean_name = v.clean_name WHERE round_even(v * 2.0 / su.num_regions, 0) > 0""")
def scale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts dealt over equal shares, weighted by regions."""
    alignment, names, summary, tables = matrix_inputs(spark, sf_dir)
    matrix = settle(counts.pivot_mean(counts.alignment_matrix(alignment, names, summary)))
    kept = counts.union_tables(tables).where("count > 0").join(alignment.select(F.col("asv").alias("feature_id")), "feature_id", "left_semi")
    # Reads of the same samples are many, so names meet their lists of samples.
    lists = kept.groupBy(F.col("feature_id").alias("asv")).agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
    met = matrix.join(lists, "asv").select("clean_name", "samples").distinct().select(F.explode("samples").alias("sample_id"), "clean_name").distinct().withColumn("one", F.lit(1.0))
    shares = counts.normalise_samples(met, "one", "f").drop("one")
    return counts.scale_counts(kept, shares, matrix, summary, "weighted", 2)


#: The iteration, each sample until its error is small; every step reads the one before.
EM = """sh AS (SELECT sample_id, asv, count / sum(count) OVER (PARTITION BY sample_id) AS y FROM kp),
w AS (SELECT sh.sample_id AS s, sh.asv AS r, av.clean_name AS c, av.a, sh.y FROM sh JOIN av ON av.asv = sh.asv WHERE av.a > 0),
em AS (SELECT s, c, f / sum(f) OVER (PARTITION BY s) AS f, FALSE AS done, 0 AS k FROM (SELECT s, c, sum(a * y) AS f FROM w GROUP BY 1, 2)
UNION ALL SELECT s, c, CASE WHEN err >= 1e-7 AND g <= 1e-9 THEN 0 ELSE g END, err < 1e-7, k + 1 FROM (
SELECT s, c, k, f * b AS g, sum(abs(1 - b) * f) OVER (PARTITION BY s) AS err FROM (
SELECT s, c, f, k, sum(a * y / (theta + 2.220446049250313e-16)) AS b FROM (
SELECT w.s, w.c, w.a, w.y, em.f, em.k, sum(w.a * em.f) OVER (PARTITION BY w.s, w.r) AS theta FROM em JOIN w ON em.s = w.s AND em.c = w.c WHERE NOT em.done AND em.f > 0 AND em.k < 100000) GROUP BY s, c, f, k))),
fs AS (SELECT s AS sample_id, c AS clean_name, f / sum(f) OVER (PARTITION BY s) AS f FROM em WHERE done AND f > 1e-9)"""
RECONSTRUCTED = f"""WITH RECURSIVE {BASE}, {SUMMARY}, {MATRIX}, {EM},
pr AS (SELECT sample_id, clean_name, f, su.num_regions, f / su.num_regions / sum(f / su.num_regions) OVER (PARTITION BY sample_id) AS g FROM fs JOIN su USING (clean_name)),
q AS (SELECT kp.sample_id, kp.asv, kp.count, av.clean_name, pr.num_regions, pr.g * av.a AS p FROM kp JOIN av ON av.asv = kp.asv JOIN pr ON pr.sample_id = kp.sample_id AND pr.clean_name = av.clean_name),
v AS (SELECT clean_name, sample_id, num_regions, sum(count * p / (s + 2.220446049250313e-16)) AS v FROM (SELECT *, sum(p) OVER (PARTITION BY sample_id, asv) AS s FROM q) GROUP BY 1, 2, 3),
rc AS (SELECT clean_name AS feature_id, sample_id, round_even(v / num_regions, 0) AS count FROM v WHERE round_even(v / num_regions, 0) > 0)"""


@query(f"WITH RECURSIVE {BASE}, {SUMMARY}, {MATRIX}, {EM} SELECT sample_id, clean_name, round(f, 6) AS f FROM fs")
def em_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of every sample."""
    alignment, names, summary, tables = matrix_inputs(spark, sf_dir)
    matrix = settle(counts.pivot_mean(counts.alignment_matrix(alignment, names, summary)))
    kept = counts.union_tables(tables).join(alignment.select(F.col("asv").alias("feature_id")), "feature_id", "left_semi")
    return counts.solve_samples(counts.normalise_samples(kept), matrix, 1e-9).withColumn("f", F.round("f", 6))


@query(f"{RECONSTRUCTED} SELECT feature_id, sample_id, count FROM rc")
def reconstruct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps, alignments, tables = two_regions(spark, sf_dir)
    names, summary = database.reconstruct_database(REGIONS, alignments, maps)
    return counts.reconstruct_counts(REGIONS, alignments, tables, names, settle(summary), min_abund=1e-9, min_counts=1)


# Taxonomy: suppliers in groups of three

TAXA = """x AS (SELECT s.s_suppkey AS k, r.r_name AS r, n.n_name AS n, CASE WHEN s.s_suppkey % 4 = 0 THEN '' ELSE CAST(s.s_suppkey // 6 AS VARCHAR) END AS c, CASE WHEN s.s_suppkey % 5 = 0 THEN '' ELSE CAST(s.s_suppkey % 2 AS VARCHAR) END AS s
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def taxa(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for t in ("supplier", "nation", "region"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"taxa_{t}")
    x = spark.sql("""SELECT CAST(s_suppkey AS STRING) AS id, CAST((s_suppkey - 1) DIV 3 AS STRING) AS g,
        concat('k__', r_name, '; p__', n_name, '; c__', IF(s_suppkey % 4 = 0, '', CAST(s_suppkey DIV 6 AS STRING)), '; s__', IF(s_suppkey % 5 = 0, '', CAST(s_suppkey % 2 AS STRING))) AS taxon
        FROM taxa_supplier JOIN taxa_nation ON s_nationkey = n_nationkey JOIN taxa_region ON n_regionkey = r_regionkey""")
    return x.select(F.col("id").alias("db_seq"), F.concat(F.lit("g"), "g").alias("clean_name")), x.select(F.col("id").alias("feature_id"), "taxon")


def taxonomy_sql(missing: str) -> str:
    none = {"c": "CASE WHEN c = '' THEN {} ELSE 'c__' || c END", "s": "CASE WHEN s = '' THEN {} ELSE 's__' || s END"}
    if missing == "ignore":
        l3, l4 = "'c__' || c", "'s__' || s"
    elif missing == "merge":
        l3, l4 = none["c"].format("NULL"), none["s"].format("NULL")
    else:
        l3 = none["c"].format("'p__' || n")
        l4 = none["s"].format(l3)
    levels = ", ".join(f"string_agg(DISTINCT l{i}, '|' ORDER BY l{i}) AS g{i}" for i in (1, 2, 3, 4))
    # A level behind a split or a gap repeats what was last known up to there.
    stop = "(g{0} IS NULL OR contains(g{0}, '|'))"
    last = ["g1", "coalesce(g2, g1)", "coalesce(g3, g2, g1)", "coalesce(g4, g3, g2, g1)"]
    case = {i: "CASE " + " ".join(f"WHEN {stop.format(j)} THEN {last[j - 1]}" for j in range(1, i + 1)) + f" ELSE g{i} END" for i in (1, 2, 3, 4)}
    return f"""WITH {TAXA}, l AS (SELECT 'g' || CAST((k - 1) // 3 AS VARCHAR) AS g, 'k__' || r AS l1, 'p__' || n AS l2, {l3} AS l3, {l4} AS l4 FROM x),
    a AS (SELECT g, {levels} FROM l GROUP BY g) SELECT g AS feature_id, {" || '; ' || ".join(case[i] for i in (1, 2, 3, 4))} AS taxon FROM a"""


def solved_taxonomy(spark: SparkSession, sf_dir: str, missing: str) -> DataFrame:
    names, known = taxa(spark, sf_dir)
    return taxonomy.reconstruct_taxonomy(names, known, "greengenes", missing)


@query(taxonomy_sql("merge"))
def taxonomy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved_taxonomy(spark, sf_dir, "merge")


@query(taxonomy_sql("inherit"))
def taxonomy_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved_taxonomy(spark, sf_dir, "inherit")


@query(taxonomy_sql("ignore"))
def taxonomy_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved_taxonomy(spark, sf_dir, "ignore")


@query(f"WITH {TAXA} SELECT CAST(k AS VARCHAR) AS id, 'ACGT' AS sequence FROM x WHERE NOT contains(lower('k__' || r || '; p__' || n || '; c__' || c || '; s__' || s), 'asia')")
def exclude_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, known = taxa(spark, sf_dir)
    return reconstruction.exclude_taxa(known, known.select(F.col("feature_id").alias("id"), F.lit("ACGT").alias("sequence")), ["Asia"])


# Fragments


@query(f"""WITH s AS (SELECT CAST(substr(id, 2) AS BIGINT) // 5 AS g, sequence FROM ({sequences_sql(24, GAPPED)})), u AS (SELECT g, k, substr(sequence, k, 1) AS c FROM (SELECT g, sequence, unnest(range(1, 25)) AS k FROM s)),
w AS (SELECT g, k, c, row_number() OVER (PARTITION BY g, k ORDER BY count(*) DESC, c = '-', c) AS r FROM u GROUP BY g, k, c)
SELECT 'g' || CAST(g AS VARCHAR) AS clean_name, replace(string_agg(c, '' ORDER BY k), '-', '') AS sequence FROM w WHERE r = 1 GROUP BY g""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir, 24, GAPPED)
    return fragments.consensus(s.select(F.concat(F.lit("g"), F.floor(F.substring("id", 2, 7).cast("long") / 5).cast("string")).alias("clean_name"), "sequence"))


@query(f"""WITH u AS (SELECT p, k, substr(sequence, k, 1) AS c FROM (SELECT CAST(substr(id, 2) AS BIGINT) // 2 AS p, sequence, unnest(range(1, 33)) AS k FROM ({sequences_sql(32)}))),
w AS (SELECT p, k, c, row_number() OVER (PARTITION BY p, k ORDER BY count(*) DESC, c) AS r FROM u GROUP BY p, k, c),
q AS (SELECT p, string_agg(c, '' ORDER BY k) AS s FROM w WHERE r = 1 GROUP BY p),
f AS (SELECT p, arg_max(k + 1, n * 100 - k) AS at FROM (SELECT p, k, CAST(substr(s, k, 1) IN ('A', 'T') AS INT) + CAST(substr(s, k + 1, 1) = 'A' AS INT) AS n FROM (SELECT p, s, unnest(range(1, 32)) AS k FROM q)) WHERE n > 0 GROUP BY p),
l AS (SELECT p, arg_max(k + 2, n * 100 - k) AS at FROM (SELECT p, k, CAST(substr(s, k, 1) = 'C' AS INT) + CAST(substr(s, k + 1, 1) IN ('A', 'G') AS INT) + CAST(substr(s, k + 2, 1) = 'T' AS INT) AS n FROM (SELECT p, s, unnest(range(1, 31)) AS k FROM q)) WHERE n > 0 GROUP BY p)
SELECT 'd' || lpad(CAST(2 * q.p AS VARCHAR), 7, '0') || '|d' || lpad(CAST(2 * q.p + 1 AS VARCHAR), 7, '0') AS id, substr(s, coalesce(f.at, 0) + 1, greatest(coalesce(l.at, 0) + 8 - coalesce(f.at, 0), 0)) AS sequence FROM q LEFT JOIN f ON f.p = q.p LEFT JOIN l ON l.p = q.p""")
def fragment_rep_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of pairs of documents; primers without an exact match are placed by their best fit."""
    s = sequences(spark, sf_dir, 32)
    pair = F.floor(F.substring("id", 2, 7).cast("long") / 2)
    name = F.concat_ws("|", F.format_string("d%07d", 2 * pair), F.format_string("d%07d", 2 * pair + 1))
    names = s.select(F.col("id").alias("db_seq"), name.alias("clean_name"), F.lit(0).alias("first_region"), F.lit("WA").alias("first_fwd_primer"), F.lit(1).alias("last_region"), F.lit("CRT").alias("last_fwd_primer"), F.lit(8).alias("last_kmer_length"))
    summary = names.select(F.col("clean_name").alias("feature_id")).distinct()
    return reconstruction.reconstruct_tree(names, summary, s)


# Files


@query(MAP_SQL)
def kmer_map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kmer map written as TSV to the shared folder and read again."""
    path = file_path(spark, "kmer-map")
    sources.write_table(coded_region(spark, sf_dir)[1], path)
    return sources.read_table(spark, path, "kmer-map", validate=True)


@query(sequences_sql(32, CODED))
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_path(spark, "fasta")
    sources.write_fasta(sequences(spark, sf_dir, 32, CODED), path)
    return sources.read_fasta(spark, path)


@query(f"SELECT feature_id, sample_id, count FROM ({ORDER_COUNTS}) WHERE count <> 0")
def feature_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_path(spark, "feature-table")
    sources.write_feature_tsv(order_counts(spark, sf_dir), path)
    return sources.read_feature_tsv(spark, path)


@query(f"SELECT feature_id, sample_id, count FROM ({ORDER_COUNTS}) WHERE count <> 0")
def biom_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_path(spark, "biom")
    sources.write_biom_json(order_counts(spark, sf_dir), path)
    return sources.read_biom_json(spark, path)


@query(ALIGNED8)
def kmer_align_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_path(spark, "kmer-align")
    sources.write_table(align_kmers(spark, sf_dir), path)
    return sources.read_table(spark, path, "kmer-align", validate=True)


@query(NAMED)
def database_map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_path(spark, "database-map")
    sources.write_table(names_and_summary(spark, sf_dir)[0], path)
    return sources.read_table(spark, path, "sidle-reconstruction-mapping", validate=True)


@query(SUMMED)
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_path(spark, "summary")
    sources.write_table(names_and_summary(spark, sf_dir)[1], path, single_file=True)
    return rounded(sources.read_table(spark, path, "sidle-summary", validate=True))


@query(f"SELECT feature_id, sample_id, count, CAST(row_number() OVER (ORDER BY feature_id, sample_id) - 1 AS VARCHAR) AS id FROM ({ORDER_COUNTS})")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_row_id(order_counts(spark, sf_dir), ["feature_id", "sample_id"])


def file_path(spark: SparkSession, name: str) -> str:
    return f"{new_path(spark)}-{name}"


# Refusals: the text of the error, or nothing


def refusal(spark: SparkSession, act: Callable[[], object]) -> DataFrame:
    try:
        act()
    except ValueError as why:
        return spark.createDataFrame([(str(why),)], "why string")
    return spark.createDataFrame([], "why string")


@query(f"""WITH {BASE}, tb AS (SELECT CASE o.region WHEN 0 THEN 'A' ELSE 'B' END || o.amp AS asv, 's' || CAST(d.doc_id % 4 AS VARCHAR) AS sample_id, sum(length(coalesce(d.text, ''))) AS count FROM o JOIN documents d ON o.id = 'd' || lpad(CAST(d.doc_id AS VARCHAR), 7, '0') GROUP BY 1, 2),
dp AS (SELECT sample_id, sum(CASE WHEN asv IN (SELECT asv FROM al) THEN count ELSE 0 END) AS depth FROM tb GROUP BY 1), low AS (SELECT count(*) AS n FROM dp WHERE depth <= 1000000000000)
SELECT 'There are ' || CAST(n AS VARCHAR) || ' samples with fewer than 1000000000000 total sequences. Please check your minimum counts and make sure your representative sequences are aligned with the database.' AS why FROM low WHERE n > 0""")
def depth_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said if no sample is deep enough."""
    _, alignments, tables = two_regions(spark, sf_dir)
    table = counts.union_tables(tables)
    kept = table.join(alignments[0].unionByName(alignments[1]).select(F.col("asv").alias("feature_id")), "feature_id", "left_semi")
    return refusal(spark, lambda: counts.check_depth(table, kept, 10**12))


@query("SELECT 'The kmers are not of a consistent length' AS why FROM (SELECT count(DISTINCT length(p_name)) AS n FROM part) WHERE n > 1")
def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of sequences of several lengths; part names stand for them."""
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("sequence"))
    return refusal(spark, lambda: align.check_read_lengths(names, "kmers"))


@query(f"WITH r AS ({sequences_sql(12)}), s AS (SELECT substr(sequence, 1, 12 - CAST(substr(id, 8, 1) AS INTEGER)) AS s FROM r) SELECT DISTINCT md5(substr(s, 1, 8)) AS id, substr(s, 1, 8) AS sequence FROM s WHERE length(s) >= 8")
def trim_short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 3 to 12 letters; those shorter than the trim length go."""
    reads = sequences(spark, sf_dir, 12).select("id", F.expr("substr(sequence, 1, 12 - cast(substr(id, 8, 1) AS int))").alias("sequence"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return trim.trim_dada2_posthoc(order_counts(spark, sf_dir), reads, 8)[1]


@query(MAP_SQL.replace("5 AS kmer_length", "'5ish' AS kmer_length").join(["SELECT DISTINCT 'The kmer-length column must be numeric' AS why FROM (", ")"]))
def validation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a kmer map whose lengths aren't numbers."""
    path = file_path(spark, "kmer-map")
    sources.write_table(coded_region(spark, sf_dir)[1].withColumn("kmer_length", F.lit("5ish")), path)
    return refusal(spark, lambda: sources.validate_table(spark, path, "kmer-map"))


# The whole


@query(f"""{RECONSTRUCTED},
lv AS (SELECT nm.clean_name AS g, 'k__x' AS l1, 'p__' || substr(t.sequence, 1, 1) AS l2, 'c__' || substr(t.sequence, 2, 3) AS l3 FROM nm JOIN ({sequences_sql(4)}) t ON t.id = nm.db_seq),
lg AS (SELECT g, string_agg(DISTINCT l1, '|') AS g1, string_agg(DISTINCT l2, '|' ORDER BY l2) AS g2, string_agg(DISTINCT l3, '|' ORDER BY l3) AS g3 FROM lv GROUP BY g)
SELECT rc.feature_id, rc.sample_id, rc.count, g1 || ';' || g2 || ';' || CASE WHEN contains(g2, '|') THEN g2 ELSE g3 END AS taxon FROM rc JOIN lg ON lg.g = rc.feature_id""")
def full_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps over two regions: counts with their taxonomy."""
    maps, alignments, tables = two_regions(spark, sf_dir)
    known = sequences(spark, sf_dir, 4).select(F.col("id").alias("feature_id"), F.concat_ws(";", F.lit("k__x"), F.concat(F.lit("p__"), F.substring("sequence", 1, 1)), F.concat(F.lit("c__"), F.substring("sequence", 2, 3))).alias("taxon"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = reconstruction.reconstruct_profiles(REGIONS, maps, alignments, tables, known, min_abund=1e-9, min_counts=1)
    return out.table.join(out.taxonomy, "feature_id")
