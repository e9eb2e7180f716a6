"""Which reference sequences can be told apart over several regions.

A reference sequence's set is, for each region that it occurs in, the union of
the ids of its kmers, and over those regions the intersection. Sequences with
the same kmers in all regions have the same set, so sets are computed once for
each distinct list of kmers (its signature), not once for each sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.functions import iupac
from strandloom.store import settle

#: Most choices of one kmer of each region by which a list of kmers meets others.
CHOICES = 64


def region_order(regions: Sequence[str]) -> dict[str, int]:
    """Each region's place: that of its first mention."""
    return {r: regions.index(r) for r in regions}


def numbered(column: str, order: dict[str, int]):
    return F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col(column)]


def union_alignments(alignments: Sequence[DataFrame], order: dict[str, int]) -> DataFrame:
    """(key, asv, region): pairs once, with the region of the first table that has them."""
    parts = [a.select(iupac.short("kmer").alias("key"), "asv", F.lit(k).alias("nth"), numbered("region", order).alias("region")) for k, a in enumerate(alignments)]
    return reduce(DataFrame.unionByName, parts).groupBy("key", "asv").agg(F.min_by("region", "nth").alias("region"))


def kmer_members(tables: Sequence[DataFrame], *of: str) -> DataFrame:
    """(``of``, key, db_seq): the sequences that each kmer names, each kmer taken apart once."""
    every = reduce(DataFrame.unionByName, (t.select(*of, "kmer") for t in tables)).distinct()
    rows = every.select(*of, iupac.short("kmer").alias("key"), F.explode(iupac.split_ids("kmer")).alias("i"))
    return rows.select(*of, "key", iupac.db_seq("i").alias("db_seq")).distinct()


def numbered_maps(kmer_maps: Sequence[DataFrame], order: dict[str, int]) -> list[DataFrame]:
    """The kmer maps, regions as numbers."""
    return [m.withColumn("region", numbered("region", order)) for m in kmer_maps]


def union_maps(kmer_maps: Sequence[DataFrame], ids: DataFrame) -> DataFrame:
    """All kmer map rows of ``ids``, with keys for kmers: a kmer names all of its
    sequences, and has as many rows."""
    columns = ["db_seq", "seq_name", iupac.short("kmer").alias("key"), "region", "fwd_primer", "rev_primer", "kmer_length"]
    every = reduce(DataFrame.unionByName, (m.select(*columns) for m in kmer_maps))
    return every.join(ids, "db_seq", "left_semi")


def signatures(kmers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(db_seq, sig), and (sig, kmers): the distinct lists of (region, key)."""
    own = kmers.groupBy("db_seq").agg(F.array_sort(F.collect_set(F.struct("region", "key"))).alias("kmers"))
    own = settle(own.withColumn("sig", F.sha2(F.to_json("kmers"), 256)))
    return own.select("db_seq", "sig"), own.select("sig", "kmers").distinct()


def choices(kmers: Column, regions: Column) -> Column:
    """A hash of each way to take one kmer of each region."""

    def further(found: Column, r: Column) -> Column:
        own = F.filter(kmers, lambda x: x["region"] == r)
        return F.flatten(F.transform(found, lambda h: F.transform(own, lambda x: F.xxhash64(h, x["region"], x["key"]))))

    return F.aggregate(regions, F.array(F.lit(0).cast("long")), further)


def sharing(lists: DataFrame, held: DataFrame) -> DataFrame:
    """(sig, held_sig): signatures ``held`` with a kmer in every region of ``sig``.

    They meet at a choice of one kmer of each region of ``sig``, so those that
    agree in a part of the regions only never meet. A list with more than
    ``CHOICES`` choices meets others at single kmers of ``sig``'s first region.
    What meets by hash is compared in full.
    """
    regions = F.array_sort(F.array_distinct(F.col("kmers.region")))
    ways = F.aggregate(regions, F.lit(1.0), lambda n, r: n * F.size(F.filter("kmers", lambda x: x["region"] == r)))
    lists, held = (settle(x.withColumns({"regions": regions, "wide": ways > CHOICES})) for x in (lists, held))
    none, kmers = F.array().cast("array<bigint>"), F.col("kmers")
    patterns = [list(r[0]) for r in lists.where("NOT wide").select("regions").distinct().collect()]
    over = F.array(*(F.array(*map(F.lit, p)) for p in patterns)) if patterns else F.array().cast("array<array<int>>")
    own = F.filter(over, lambda p: F.size(F.array_except(p, F.col("regions"))) == 0)

    def tagged(tag: str, found: Column) -> Column:
        return F.transform(found, lambda h: F.struct(F.lit(tag).alias("tag"), h.alias("h")))

    def single(found: Column) -> Column:
        return F.transform(found, lambda x: F.xxhash64(x["region"], x["key"]))

    first = single(F.filter("kmers", lambda x: x["region"] == F.col("regions")[0]))
    narrow = ~F.col("wide")
    left = F.concat(tagged("all", F.when(narrow, choices(kmers, F.col("regions"))).otherwise(none)), tagged("to wide", F.when(narrow, first).otherwise(none)), tagged("from wide", F.when(narrow, none).otherwise(first)))
    met = F.flatten(F.transform(own, lambda p: choices(kmers, p)))
    right = F.concat(tagged("all", F.when(narrow, met).otherwise(none)), tagged("to wide", F.when(narrow, none).otherwise(single(kmers))), tagged("from wide", single(kmers)))
    some = lists.select("sig", "kmers", F.size("regions").alias("n"), F.explode(left).alias("at"))
    others = held.select(F.col("sig").alias("held_sig"), F.col("kmers").alias("held_kmers"), F.explode(right).alias("at"))
    agreed = F.array_distinct(F.array_intersect("kmers", "held_kmers")["region"])
    return some.join(others, "at").where(F.size(agreed) == F.col("n")).select("sig", "held_sig").distinct()


def shared_sets(kmers: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(db_seq, sig), and (sig, j): ids that share a kmer in every region of the signature.

    ``members`` are the sequences (region, key, db_seq) that kmers name. They have
    signatures too, so sequences are matched once for each pair of these.
    """
    owners, lists = signatures(kmers)
    holders, held = signatures(members.join(owners, "db_seq", "left_semi"))
    pairs = sharing(lists, held)
    return owners, pairs.join(holders.select(F.col("db_seq").alias("j"), F.col("sig").alias("held_sig")), "held_sig").select("sig", "j")


def tidy_sets(owners: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(db_seq, name) of sets K whose owners are exactly K, and (name, clean_name):
    a name is as long as its set, so rows get its short form."""
    names = settle(sets.groupBy("sig").agg(iupac.join_ids(F.collect_set("j")).alias("clean_name")).withColumn("name", iupac.short("clean_name")))
    named = owners.join(names.select("sig", "name"), "sig")
    held = named.groupBy("name").agg(iupac.join_ids(F.collect_set("db_seq")).alias("held"))
    labels = settle(names.select("name", "clean_name").distinct().join(held, "name").where("clean_name = held").select("name", "clean_name"))
    return named.join(labels.select("name"), "name", "left_semi").select("db_seq", "name"), labels


def tidy_names(owners: DataFrame, sets: DataFrame) -> DataFrame:
    """(db_seq, clean_name) of sets K whose owners are exactly K."""
    return labelled(*tidy_sets(owners, sets))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with clean_name for name."""
    return rows.join(labels, "name").drop("name")


def without(owners: DataFrame, sets: DataFrame, solved: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = solved.select("db_seq")
    return owners.join(ids, "db_seq", "left_anti"), sets.join(ids.withColumnRenamed("db_seq", "j"), "j", "left_anti")


def detangle(edges: DataFrame) -> DataFrame:
    """(db_seq, clean_name) from edges (i, j), j in the set of i.

    A sequence's penalty is how far its set exceeds the smallest among its
    neighbours. Edges between equal penalties stay. The rule is directed and not
    transitive, so these are not connected components.
    """
    degree = edges.groupBy("i").agg(F.count("*").alias("deg"))
    of_j = degree.select(F.col("i").alias("j"), F.col("deg").alias("deg_j"))
    least = edges.join(of_j, "j").groupBy("i").agg(F.min("deg_j").alias("least"))
    penalty = settle(degree.join(least, "i").select("i", (F.col("deg") - F.col("least") + 1).alias("pen")))
    of_j = penalty.select(F.col("i").alias("j"), F.col("pen").alias("pen_j"))
    every = edges.union(degree.select("i", F.col("i").alias("j"))).distinct()
    stay = every.join(penalty, "i").join(of_j, "j").where("pen = pen_j")
    return stay.groupBy("i").agg(iupac.join_ids(F.collect_set("j")).alias("clean_name")).withColumnRenamed("i", "db_seq")


def detangle_sets(owners: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``detangle`` of every owner's set, once for each signature: owners of one
    signature have one set, so they have one degree, penalty and name. A group of
    equal sequences costs as many rows as it has members, not their square.
    Returned are (db_seq, name) and (name, clean_name), as of ``tidy_sets``.

    An owner that its own set lacks gets a signature of its own.
    """
    odd = owners.join(sets.select("sig", F.col("j").alias("db_seq")), ["sig", "db_seq"], "left_anti")
    if not odd.isEmpty():
        odd = odd.withColumn("own", F.concat_ws(":", "sig", "db_seq"))
        sets = sets.union(odd.join(sets, "sig").select("own", "j")).union(odd.select("own", "db_seq"))
        owners = owners.join(odd, ["sig", "db_seq"], "left_anti").select("db_seq", "sig").union(odd.select("db_seq", "own"))
    members = settle(sets.join(owners.select(F.col("db_seq").alias("j"), F.col("sig").alias("sig_j")), "j"))
    near = members.groupBy("sig", "sig_j").agg(F.count("*").alias("n"))
    degree = near.groupBy("sig").agg(F.sum("n").alias("deg"))
    least = near.join(degree.withColumnsRenamed({"sig": "sig_j", "deg": "deg_j"}), "sig_j").groupBy("sig").agg(F.min("deg_j").alias("least"))
    penalty = settle(degree.join(least, "sig").select("sig", (F.col("deg") - F.col("least") + 1).alias("pen")))
    stay = near.join(penalty, "sig").join(penalty.withColumnsRenamed({"sig": "sig_j", "pen": "pen_j"}), "sig_j").where("pen = pen_j")
    names = members.join(stay.select("sig", "sig_j"), ["sig", "sig_j"], "left_semi").groupBy("sig").agg(iupac.join_ids(F.collect_set("j")).alias("clean_name"))
    names = settle(names.withColumn("name", iupac.short("clean_name")))
    return owners.join(names.select("sig", "name"), "sig").select("db_seq", "name"), names.select("name", "clean_name").distinct()


def detangle_groups(owners: DataFrame, sets: DataFrame) -> DataFrame:
    """(db_seq, clean_name) of ``detangle_sets``."""
    return labelled(*detangle_sets(owners, sets))


def solve_sets(kmers: DataFrame, members: DataFrame, strict_round2: bool = False) -> tuple[DataFrame, DataFrame]:
    """(db_seq, name) of every sequence, and (name, clean_name).

    Tidy sets are named first, the rest is detangled. ``strict_round2`` looks for
    tidy sets once more in between, which the reference's results don't show.
    """
    owners, sets = map(settle, shared_sets(kmers, members))
    found = [tidy_sets(owners, sets)]
    for k in range(1 + strict_round2):
        solved = settle(found[k][0])
        owners, sets = map(settle, without(owners, sets, solved))
        found[k:] = [(solved, found[k][1]), (tidy_sets if k < strict_round2 else detangle_sets)(owners, sets)]
    names, labels = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
    return names, labels.distinct()


def solve_names(kmers: DataFrame, strict_round2: bool = False) -> DataFrame:
    """(db_seq, clean_name) of every sequence of a kmer map whose regions are numbers."""
    members = kmer_members([kmers], "region")
    return labelled(*solve_sets(kmers.withColumn("key", iupac.short("kmer")), members, strict_round2))


def database_map(kmers: DataFrame, names: DataFrame) -> DataFrame:
    """First and last region of every solved sequence."""
    ends = kmers.groupBy("db_seq").agg(
        F.min(F.struct("region", "fwd_primer")).alias("first"),
        F.max(F.struct("region", "fwd_primer", "kmer_length")).alias("last"),
    )
    return names.join(ends, "db_seq").select(
        "db_seq",
        "name",
        F.col("first.region").alias("first_region"),
        F.col("first.fwd_primer").alias("first_fwd_primer"),
        F.col("last.region").alias("last_region"),
        F.col("last.fwd_primer").alias("last_fwd_primer"),
        F.col("last.kmer_length").alias("last_kmer_length"),
    )


def count_mapping(named: DataFrame, count_degenerates: bool = True) -> DataFrame:
    """Regions of each name, and kmers mapped in them."""
    unit = "seq_name" if count_degenerates else "db_seq"
    per_region = named.select("name", unit, "region").distinct().groupBy("name", "region").agg(F.count("*").alias("n"))
    return per_region.groupBy("name").agg(
        F.count("*").cast("int").alias("num_regions"),
        F.sum("n").alias("total_kmers_mapped"),
        F.avg("n").alias("mean_kmer_per_region"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("stdv_kmer_per_region"),
    )


def mapped_asvs(aligned: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """(name, mapped_asvs) in the order of region and ASV."""
    named = members.join(names, "db_seq").select("key", "name").distinct()
    once = aligned.join(named, "key").groupBy("name", "asv").agg(F.min("region").alias("region"))
    ordered = F.array_sort(F.collect_list(F.struct("region", "asv")))
    return once.groupBy("name").agg(ordered.alias("x")).select("name", F.array_join("x.asv", "|").alias("mapped_asvs"))


def reconstruct_database(
    region: Sequence[str],
    regional_alignment: Sequence[DataFrame],
    kmer_map: Sequence[DataFrame],
    count_degenerates: bool = True,
    strict_round2: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The database map and its summary."""
    order = region_order(list(region))
    # Each of these is read several times below.
    aligned = settle(union_alignments(regional_alignment, order))
    members = settle(kmer_members(regional_alignment))
    maps = numbered_maps(kmer_map, order)
    kmers = settle(union_maps(maps, members.select("db_seq").distinct()))
    names, labels = map(settle, solve_sets(kmers, kmer_members(maps, "region"), strict_round2))
    counts = count_mapping(kmers.join(names, "db_seq"), count_degenerates)
    summary = labelled(counts.join(mapped_asvs(aligned, members, names), "name", "left"), labels)
    return labelled(database_map(kmers, names), labels).select(*schemas.DATABASE_MAP.names), summary.select(F.col("clean_name").alias("feature_id"), *schemas.SUMMARY.names[1:])
