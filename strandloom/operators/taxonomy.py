"""Taxonomies of groups of sequences that can't be told apart."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import iupac

from .counts import require_known

# The delimiters of the databases.
DELIMITERS = {"greengenes": "; ", "silva": ";", "homd": ";", "none": ";"}
MISSING = ("merge", "inherit", "ignore")
AMBIGUITY = ("missing", "ignore")


def defined(level: Column, database: str) -> Column:
    """Whether a level says something, by the database's habits."""
    if database == "greengenes":
        return F.length(level) > 3
    if database == "silva":
        return ~(level.contains("uncul") | level.contains("metagenome"))
    return F.lit(True)


def warn(database: str, define_missing: str, ambiguity_handling: str) -> None:
    # Fixed texts.
    if database == "none" and define_missing != "ignore":
        warnings.warn("When no database is specified, missing values are ignored by default", UserWarning, stacklevel=3)
    if database == "none" and ambiguity_handling != "ignore":
        warnings.warn("When no database is specified, ambiguious values are ignored by default", UserWarning, stacklevel=3)
    if database == "greengenes" and ambiguity_handling != "ignore":
        warnings.warn("Greengenes does not include ambigious taxa. The ambiguity handling will be ignored.", UserWarning, stacklevel=3)


def split_levels(taxon: Column, delimiter: str) -> Column:
    return F.transform(F.split(taxon, "\\Q" + delimiter + "\\E"), lambda x: F.trim(x))


def cleaned(levels: Column, database: str, define_missing: str, ambiguity_handling: str) -> Column:
    """Levels with the undefined ones null, or replaced by the level before."""
    if define_missing == "ignore":
        return levels
    first_ambiguous = F.lit(0)
    if ambiguity_handling == "missing":
        first_ambiguous = F.array_position(F.transform(levels, lambda x: x.contains("ambig")), F.lit(True))

    def one(x: Column, i: Column) -> Column:
        hidden = (first_ambiguous > 0) & (i + 1 >= first_ambiguous)
        return F.when(defined(x, database) & ~hidden, x)

    out = F.transform(levels, one)
    if define_missing == "inherit":
        # Each level takes the last defined one up to its own.
        out = F.transform(out, lambda x, i: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.slice(out, F.lit(1), i + 1), lambda y: y.isNotNull())), -1))
    return out


def settled(levels: Column) -> Column:
    """Levels behind the first that is missing or split repeat what was last known."""
    split_at = F.array_position(F.transform(levels, lambda x: x.isNull() | x.contains("|")), F.lit(True))
    head = F.when(split_at > 0, F.slice(levels, F.lit(1), F.greatest(split_at, F.lit(1)).cast("int"))).otherwise(levels)
    known = F.filter(head, lambda x: x.isNotNull())
    last = F.when(F.size(known) > 0, F.element_at(known, -1))
    return F.transform(levels, lambda x, i: F.when((split_at > 0) & (i + 1 >= split_at), last).otherwise(x))


def reconstruct_taxonomy(reconstruction_map: DataFrame, taxonomy: DataFrame, database: str = "none", define_missing: str = "merge", ambiguity_handling: str = "ignore") -> DataFrame:
    """(feature_id, taxon) of every clean name.

    All sequences of the map must have a taxon, all of one depth of two levels or more.
    """
    if database not in DELIMITERS:
        raise TypeError(f"unknown database {database!r}")
    if define_missing not in MISSING or ambiguity_handling not in AMBIGUITY:
        raise ValueError(f"define_missing must be one of {MISSING}, ambiguity_handling one of {AMBIGUITY}")
    warn(database, define_missing, ambiguity_handling)
    delimiter = DELIMITERS[database]
    known = taxonomy.select(F.col("feature_id").alias("db_seq"), "taxon")
    require_known(reconstruction_map, known, "db_seq", "the taxonomy")
    # A name is as long as its group, so rows have its short form.
    labels = reconstruction_map.select(iupac.short("clean_name").alias("name"), F.col("clean_name").alias("feature_id")).distinct()
    rows = reconstruction_map.select("db_seq", iupac.short("clean_name").alias("name")).join(known, "db_seq").select("name", split_levels(F.col("taxon"), delimiter).alias("levels"))
    low, high = rows.agg(F.min(F.size("levels")), F.max(F.size("levels"))).first()
    if high == 1:
        # Fixed text.
        raise ValueError("Only one taxonomic level was found. Please check your database and delimiter.")
    if low != high:
        raise ValueError(f"The taxonomy has between {low} and {high} levels; all must have the same number.")
    rows = rows.select("name", F.posexplode(cleaned(F.col("levels"), database, define_missing, ambiguity_handling)).alias("k", "level"))
    level = F.array_join(F.array_sort(F.collect_set("level")), "|")
    merged = rows.groupBy("name", "k").agg(F.when(F.count("level") > 0, level).alias("level"))
    whole = merged.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "level"))).alias("x"))
    return whole.join(labels, "name").select("feature_id", F.array_join(settled(F.col("x.level")), delimiter).alias("taxon"))
