"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures: one permutation spreads a text's shingles over a circle, a second,
shifted step by step, gives every coordinate; the minima over all shingles are
contiguous slices of one array. Equal shingle sets are one class with one
representative, so copies never meet in pairs.

Links: a representative is first paired with one hub, the most central one
that it shares a band bucket with; the pairs are verified on full sets and linked
rows contracted to components. Large buckets that still hold several components
then get another hub in each of a few rounds, which meets members of other
components only; a round makes one pair a row at most, however large a bucket
is. In small buckets each row meets the bucket's own hub. What is left, pairs of a bucket but of different components that can meet the
threshold by exact bounds, is verified too. A pair inside a component can't
change the result, so no link that a band shows is lost.

Components: links are hooked to the smaller end, roots found by pointer jumping, and
the links between roots taken again, over tables in the shared folder. Joins on a
key that may be hot read both sides from such tables, so adaptive execution can
split them.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, append_columns, attach_group, table, texts

#: Places on the circle, and the seed of both permutations.
CIRCLE, SEED = 1 << 20, 9
#: Rows and bands by threshold: a pair at the threshold is missed with a chance under ``MISS``. Below these they are derived.
BANDS = ((85, 5, 25), (80, 4, 32))
MISS, MOST_BANDS = 1e-6, 64
#: A shingle is rare if so many of the documents in question have it at most.
RARE = 32
#: Longs in a parity sketch of a set.
SKETCH = 8
#: Pairs whose ids may be sent to all tasks.
FEW_PAIRS = 50_000
#: Rounds of further hubs, for buckets of more rows than this.
ROUNDS, SMALL = 4, 8
REMEMBERED = 400_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U64 = np.uint64


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands for a threshold in percent: as many rows as leave few bands."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    for least, rows, bands in BANDS:
        if percent >= least:
            return rows, bands
    for rows in (4, 3, 2, 1):
        bands = int(np.log(MISS) / np.log1p(-((percent / 100) ** rows))) + 1
        if bands <= MOST_BANDS or rows == 1:
            break
    return rows, bands


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


class Shingler:
    """The distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        self.factors = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, words).astype(_U64) | _U64(1)

    def __call__(self, text: str) -> np.ndarray:
        listed = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(listed).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        n = len(listed)
        if not n:
            return np.zeros(0, _U64)
        h = np.fromiter(map(known.__getitem__, listed), _U64, n)
        k = min(self.words, n)
        total = np.full(n - k + 1, k, _U64)
        for j in range(k):
            total = mixed(total + h[j : n - k + 1 + j] * self.factors[j])
        return np.unique(total)


class Circulant:
    """Signatures of ``rows * bands`` coordinates and their band keys."""

    def __init__(self, rows: int, bands: int):
        rng = np.random.default_rng(SEED)
        self.rows, self.bands, self.size = rows, bands, rows * bands
        self.spread = rng.permutation(CIRCLE).astype(np.int32)
        values = rng.permutation(CIRCLE).astype(np.int32)
        # Row p: the values that the shifted permutations 0, 1, ... give place p.
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate((values[-(self.size - 1) :], values)), self.size)
        self.factors = rng.integers(1 << 62, 1 << 63, rows).astype(_U64) | _U64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.spread[(shingles & _U64(CIRCLE - 1)).astype(np.int64)]
        low = None
        for k in range(0, len(places), 4096):
            own = self.shifted[places[k : k + 4096]].min(axis=0)
            low = own if low is None else np.minimum(low, own)
        return low

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.reshape(self.bands, self.rows).astype(_U64)
        total = np.arange(1, self.bands + 1, dtype=_U64)
        for j in range(self.rows):
            total = mixed(total + parts[:, j] * self.factors[j])
        return total.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, words: int, rows: int, bands: int) -> DataFrame:
    """(key, n_shingles, set_key, bands) of each row; an empty set is a class of its own key and has no bands."""

    def make():
        shingles, circle = Shingler(words), Circulant(rows, bands)

        def work(part: pa.RecordBatch) -> list:
            n, sets, keys = [], [], []
            for k, t in zip(part.column(part.schema.get_field_index(key)).to_pylist(), texts(part, text), strict=True):
                own = shingles(t)
                n.append(len(own))
                sets.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else f"empty {k}".encode())
                keys.append(circle.band_keys(circle.signature(own)).tolist() if len(own) else [])
            return [n, sets, keys]

        return work

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return append_columns(docs, text, fields, make, [key])


def shingle_sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, shingles) of each row."""

    def make():
        shingles = Shingler(words)
        return lambda part: [[shingles(t).view(np.int64).tolist() for t in texts(part, text)]]

    field = T.StructField("shingles", T.ArrayType(T.LongType()))
    return append_columns(docs, text, [field], make, [key]).withColumnRenamed(key, "id")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows of the written table ``pairs`` (x, y and others) whose sets meet the
    threshold, confirmed on full sets.

    The sets of a few pairs are picked out where they lie: their ids, a bounded
    number, are sent to all tasks.
    """
    if pairs.count() <= FEW_PAIRS:
        few = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
        sets = sets.join(F.broadcast(few), "id", "left_semi")
    a = sets.select(F.col("id").alias("x"), F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("y"), F.col("shingles").alias("b"))
    na, nb = F.size("a"), F.size("b")
    # Shuffled at every size, so that small inputs cost in proportion.
    both = pairs.hint("merge").join(a, "x").hint("merge").join(b, "y").where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    shared = F.size(F.array_intersect("a", "b"))
    return both.withColumn("__i", shared).where(100 * F.col("__i") >= percent * (na + nb - F.col("__i"))).select(*pairs.columns)


def rooted(parents: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(id, label): the root above each id, by pointer jumping over a forest of (id, label)."""
    label, step = shelf.put(parents.select("id", "label"), f"{name}-0"), 0
    while True:
        step += 1
        up = label.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = label.join(up, "label", "left").select("id", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved"))
        label = shelf.put(jumped, f"{name}-{step}")
        shelf.drop(f"{name}-{step - 1}")
        if label.where("moved").isEmpty():
            return label.select("id", "label")
        label = label.select("id", "label")


def relabelled(label: DataFrame, to: DataFrame) -> DataFrame:
    """(id, label) after the labels that ``to`` names have moved on."""
    on = to.select(F.col("id").alias("label"), F.col("label").alias("next"))
    return label.join(on, "label", "left").select("id", F.coalesce("next", "label").alias("label")).union(to.select("id", "label"))


def components(edges: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(id, label): for each end of ``edges`` (a, b) that isn't itself one, the root of its component."""
    edges = shelf.put(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges0")
    label, step = None, 0
    while not edges.isEmpty():
        # Each id hooks to its smallest neighbour if that is smaller, so there are no cycles.
        forest = rooted(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")), shelf, f"{name}-forest{step}")
        label = forest if label is None else shelf.put(relabelled(label, forest), f"{name}-{step}")
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(forest.select(F.col("id").alias(end), F.col("label").alias("root")), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        step += 1
        edges = shelf.put(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges{step}")
        shelf.drop(f"{name}-edges{step - 1}")
    shelf.drop(f"{name}-edges{step}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")) if label is None else label


def labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    return members.join(label.withColumnRenamed("id", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))


def hub_pairs(rows: DataFrame, step: int) -> DataFrame:
    """(x, y, label, other): each row of a split bucket with one hub of another component, at most one pair a row."""
    drawn = F.xxhash64(F.lit(step), F.col("x"))
    hubs = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(drawn.alias("h"), F.col("x").alias("y"), F.col("label").alias("other"))).alias("hub"))
    met = rows.join(hubs.where("low <> high").select("band", "hub"), "band").where("label <> hub.other")
    return met.groupBy("x", "label").agg(F.min("hub").alias("hub")).select("x", "hub.y", "label", "hub.other")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs``: key, n_shingles, component_id.

    Words are runs of other than white space after lower-casing A-Z. Sets of
    shingles of ``words`` words (fewer words: the whole sequence as one) are
    linked if 100 * intersection >= ``percent`` * union; component_id is the
    smallest key reachable. Keys are integers; rows that repeat a key are taken
    to repeat its text. Null and empty texts have no shingles and are linked
    with nothing. A row without a key is linked with nothing but equal sets, and
    has a null component_id if no such row has a key. Empty tables give none.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    rows, bands = banding(percent)
    docs = docs.select(F.col(key), F.col(text))
    signed = shelf.put(signatures(docs, key, text, words, rows, bands), "signed")

    heads = signed.where("n_shingles > 0").groupBy("set_key", "n_shingles", "bands").agg(F.min(key).alias("x")).where("x IS NOT NULL")
    heads = shelf.put(heads.select("x", F.col("n_shingles").alias("n"), "bands"), "heads")
    banded = heads.select("x", "n", F.explode("bands").alias("band"))
    buckets = shelf.put(banded.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    members = shelf.put(banded.join(buckets, "band"), "members")

    # Central rows share their buckets with many; the most central of a bucket is its hub.
    central = members.groupBy("x").agg(F.sum("rows").alias("c"))
    ranked = shelf.put(members.join(central.withColumnRenamed("x", "__x"), F.col("x") == F.col("__x")).select("band", "x", F.struct("c", (-F.col("x")).alias("less"), F.col("x").alias("y")).alias("rank")), "ranked")
    hubs = shelf.put(ranked.groupBy("band").agg(F.max("rank").alias("hub")), "hubs")
    stars = shelf.put(ranked.join(hubs, "band").groupBy("x").agg(F.max("hub").alias("hub")).select("x", F.col("hub.y").alias("y")), "stars")
    sets = shelf.put(shingle_sets(docs.join(stars.select(F.col("x").alias(key)).hint("merge"), key, "left_semi"), key, text, words).dropDuplicates(["id"]), "sets")
    starred = shelf.put(stars.where("x <> y"), "starred")
    label = rooted(verified(starred, sets, percent).select(F.col("x").alias("id"), F.col("y").alias("label")), shelf, "first")

    for step in range(ROUNDS):
        open_ = shelf.put(labelled(members.where(F.col("rows") > SMALL), label), f"open{step}")
        pairs = shelf.put(hub_pairs(open_, step), f"pairs{step}")
        links = shelf.put(verified(pairs, sets, percent), f"links{step}")
        shelf.drop(f"open{step}")
        if links.isEmpty():
            break
        label = shelf.put(relabelled(label, components(links.select(F.col("label").alias("a"), F.col("other").alias("b")), shelf, f"hub{step}")), f"label{step}")

    met = members.join(hubs.select("band", F.col("hub.y").alias("hub")), "band").join(stars.withColumnRenamed("y", "star"), "x")
    met = shelf.put(met, "met")
    for name, pairs in (("own", small_stars), ("further", further_pairs)):
        more = shelf.put(pairs(shelf.put(labelled(met, label), f"{name}-rows"), sets, percent, shelf), name)
        found = shelf.put(verified(more, sets, percent), f"{name}-links")
        if not found.isEmpty():
            label = shelf.put(relabelled(label, components(found.select(F.col("label").alias("a"), F.col("other").alias("b")), shelf, f"{name}-merge")), f"{name}-label")
    least = label.groupBy("label").agg(F.min("id").alias("m")).select("label", F.least("m", "label").alias("least"))
    named = shelf.put(label.join(least, "label").select("id", "least").union(least.select("label", "least")), "named")
    shelf.keep("signed", "named")

    def reached(whole: DataFrame) -> DataFrame:
        known = named.select(F.col("id").alias("__head"), "least")
        return whole.join(known, "__head", "left").select("set_key", F.coalesce("least", "__head").alias("component_id"))

    out = attach_group(signed.select(key, "n_shingles", "set_key"), ["set_key"], [key], {"__head": ("min", key)}, reached)
    return out.select(key, "n_shingles", "component_id")


def small_stars(rows: DataFrame, sets: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """(x, y, label, other): rows of small split buckets with the bucket's hub, of another component."""
    small = rows.where(F.col("rows") <= SMALL)
    split = small.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("x") == F.col("hub"), F.col("label"))).alias("other"))
    met = small.join(split.where("low <> high").select("band", "other"), "band").where("label <> other AND hub <> star")
    return met.select("x", F.col("hub").alias("y"), "label", "other").distinct()


def parity(gram: str) -> Column:
    """Aggregate: ``SKETCH`` longs; each bit says whether an odd number of the hashes fall on it."""
    at = F.pmod(F.shiftright(gram, 6), F.lit(SKETCH))
    bit = F.expr(f"shiftleft(1L, cast({gram} & 63 as int))")
    return F.array(*(F.bit_xor(F.when(at == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(SKETCH)))


def further_pairs(known: DataFrame, sets: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """(x, y, label, other): pairs of one bucket but different components that were
    not tested with a hub, and that can meet the threshold.

    Shingles that no other of these documents has can't be shared, which bounds
    a pair's similarity; so does leaving out the rare ones, unless the pair has
    a rare one in common. Pairs of a bucket are therefore needed only where the
    frequent shingles alone reach the threshold; all others that could meet it
    share a rare shingle and are found by that. Pairs of a bucket must also
    pass parity sketches: a bit that differs between two sketches stands for a
    shingle at least that only one set has, and too many of those rule the
    threshold out. All three are exact.
    """
    left = known.where((F.col("rows") > SMALL) | (F.col("x") != F.col("hub")))
    split = left.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    rows = shelf.put(left.join(split, "band", "left_semi").select("band", "x", "n", "label", "star"), "open")

    own = rows.select("x", "n", "label", "star").distinct()
    grams = sets.join(own.select(F.col("x").alias("id")), "id", "left_semi").select(F.col("id").alias("x"), F.explode("shingles").alias("g"))
    shared = grams.join(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")
    counts = shared.groupBy("x").agg(F.count("*").alias("c"), F.sum((F.col("df") > RARE).cast("long")).alias("f"), parity("g").alias("sketch"))
    able = shelf.put(own.join(counts, "x").where(100 * F.col("c") >= percent * F.col("n")), "able")
    rare = shelf.put(shared.where(F.col("df") <= RARE).select("g", "x").join(able.drop("sketch"), "x").select("g", "x", "n", "label", "star", "c"), "rare")

    def meet(table: DataFrame, key: str, held: str, once: bool = False) -> DataFrame:
        a, b = table.alias("a"), table.alias("b")
        na, nb, most = F.col("a.n"), F.col("b.n"), F.least(f"a.{held}", f"b.{held}")
        near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.x") < F.col("b.x")) & (F.col("a.label") != F.col("b.label"))
        near &= (F.col("a.star") != F.col("b.x")) & (F.col("b.star") != F.col("a.x"))
        near &= (100 * na >= percent * nb) & (100 * nb >= percent * na) & (100 * most >= percent * (na + nb - most))
        if once:  # in the first bucket that the pair has in common
            flips = reduce(add, (F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(SKETCH)))
            # Shingles of one set alone: those that no other set has, and those that the sketches show.
            apart = na - F.col("a.c") + nb - F.col("b.c") + flips
            near &= (100 + percent) * apart <= (100 - percent) * (na + nb)
            near &= F.get(F.array_intersect("a.bands", "b.bands"), F.lit(0)) == F.col("a.band")
        return a.join(b, near).select(F.col("a.x").alias("x"), F.col("b.x").alias("y"), F.col("a.label").alias("label"), F.col("b.label").alias("other"))

    listed = rows.groupBy("x").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    listed = listed.join(able.select("x", "n", "label", "star", "c", "f", "sketch"), "x").withColumn("band", F.explode("bands"))
    by_band = shelf.put(listed, "by-band")
    return meet(by_band, "band", "f", once=True).union(meet(rare, "g", "c")).distinct()


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


SQL = {
    "op9_near_dedup": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x AS i, y AS j FROM l UNION SELECT y, x FROM l),
t AS (SELECT i, j FROM e UNION SELECT t.i, e.j FROM t JOIN e ON t.j = e.i),
m AS (SELECT i, min(j) AS j FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.j, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.j, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.i = d.doc_id""",
}
