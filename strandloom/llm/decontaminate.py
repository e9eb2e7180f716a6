"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a slice of at most ``common.SLICE_BYTES`` of text. Its words become
numbers of the benchmark's vocabulary; stretches of known words that are too
short to hold any phrase are squeezed out, and the rest is indexed: suffix
array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions.
All phrases are searched backwards at once through the ranks, occurrences are
located by walking to a sampled position, and their spans are merged.

Nothing is shuffled. A phrase that a third of the documents share costs no more
than its occurrences. The benchmark is taken in blocks of ``BLOCK_BYTES``, one
narrow pass over the documents for each block, whose rows are written before the
next; so driver, tasks and what goes to the executors hold one block at once.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, Shelf, append_columns, others, table, texts

WINDOW = 10
#: Bytes of benchmark text that one pass over the documents takes.
BLOCK_BYTES = 8 << 20
#: Every so many text positions the suffix position is kept.
SAMPLE = 8

#: Lower-cases A-Z; bytes that belong to no word become spaces.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
assert all(WORD_BYTES[ord(c)] == ord(c) + 32 for c in UPPER)


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


class WaveletMatrix:
    """Ranks and access over an array of small integers, one bit a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros_like(end)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[start], ones[end]
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start

    def at(self, row: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[row]
            bit = ones[row + 1] - a
            symbol = symbol * 2 + bit
            row = np.where(bit == 1, zeros + a, row - a)
        return symbol


class FMIndex:
    """Over numbers of 1 and more; each 0 separates, and the last number is 0."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        cuts = text == 0
        n_cuts = int(cuts.sum())
        # Separators differ from each other, so that suffixes are compared no further.
        rank = np.where(cuts, np.cumsum(cuts) - 1, text.astype(np.int64) + n_cuts)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (max(n, int(rank.max())) + 2) + after
            order = np.argsort(key, kind="stable")
            held = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(held[1:] != held[:-1])))
            if rank.max() == n - 1 or step >= n:
                break
            step *= 2
        self.n = n
        self.tree = WaveletMatrix(text[order - 1].astype(np.int64), top)
        self.first = n_cuts + np.concatenate(([0, 0], np.cumsum(np.bincount(text[~cuts], minlength=top + 1)[1:])))
        starts_run = np.concatenate(([True], cuts[:-1]))
        marked = (np.arange(n) % SAMPLE == 0) | starts_run
        self.marked = marked[order]
        self.nth = np.cumsum(self.marked) - 1
        self.kept = order[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length: the rows whose suffixes begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        found, steps = np.zeros(len(rows), np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            there = self.marked[rows]
            found[open_[there]] = self.kept[self.nth[rows[there]]] + steps
            open_, rows = open_[~there], rows[~there]
            symbol = self.tree.at(rows)
            rows = self.first[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return found


class Phrases:
    """The distinct windows of some items, as numbers of their own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                owners[tuple(ids[k : k + window])].add(item)
        self.items = sorted({i for o in owners.values() for i in o})
        number = {x: k for k, x in enumerate(self.items)}
        self.shortest = min(map(len, owners), default=0)
        self.groups = []  # (array of phrases of one length, the items of each: offsets and numbers)
        for length in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == length]
            held = [sorted(number[i] for i in owners[p]) for p in own]
            self.groups.append((np.array(own, np.int64), np.cumsum([0, *map(len, held)]), np.array([i for h in held for i in h], np.int64)))


def scan_shard(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """For each document the merged word spans of all occurrences, and the items' numbers."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[int]] = [set() for _ in docs]
    get = phrases.vocabulary.get
    if not phrases.groups:
        return spans, items
    ids = np.zeros(sum(map(len, docs)) + len(docs), np.int64)  # a 0 after each document
    offsets = np.zeros(len(docs) + 1, np.int64)
    at = 0
    for k, d in enumerate(docs):
        ids[at : at + len(d)] = [get(w, 0) for w in d]
        at += len(d) + 1
        offsets[k + 1] = at
    known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    edges = np.diff(known)
    starts = np.flatnonzero(edges == 1)
    lengths = np.flatnonzero(edges == -1) - starts
    keep = lengths >= phrases.shortest
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return spans, items
    where = ranges(starts, lengths + 1)  # with the 0 (or unknown word) that ends the stretch
    text = ids[where]
    index = FMIndex(text, len(phrases.vocabulary))
    hit = np.zeros(len(ids) + 1, np.int64)
    for own, item_offsets, item_numbers in phrases.groups:
        low, high = index.search(own)
        n = high - low
        place = where[index.locate(ranges(low, n))]
        which = np.repeat(np.arange(len(own)), n)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + own.shape[1], -1)
        doc = np.searchsorted(offsets, place, side="right") - 1
        pairs = np.unique(np.stack((doc, which), axis=1), axis=0)
        for d, w in pairs.tolist():
            items[d].update(item_numbers[item_offsets[w] : item_offsets[w + 1]].tolist())
    edges = np.diff(np.concatenate(([0], (np.cumsum(hit) > 0).astype(np.int8), [0])))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    for d, b, e in zip(doc.tolist(), (begin - offsets[doc]).tolist(), (end - offsets[doc]).tolist(), strict=True):
        spans[d].append((b, e))
    return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
NEW = {"n_words": T.LongType(), "hit_spans": SPANS, "hit_items": T.ArrayType(T.StringType())}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, prefix: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of ``docs`` with the spans of its words that stand in an item's window.

    Adds n_words, hit_spans (merged, word positions, end exclusive) and hit_items
    (item ids as strings, distinct, unordered), each name after ``prefix``. ``keep``
    names the columns to keep (all); a new column replaces those of its name in any case.

    A null or wordless text has no words, spans or items. Items without id or
    words are left out; repeated items count once. An empty benchmark hits
    nothing. Repeated documents each get their row. Very long texts are whole.
    """
    names = [f"{prefix}{n}" for n in NEW]
    keep = others(docs.columns if keep is None else keep, names)
    bench = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    shelf = Shelf(docs.sparkSession) if blocks > 1 else None
    out = docs
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        phrases = Phrases([(r.i, r.t) for r in part.collect()], window)  # about block_bytes
        last = k == blocks - 1
        out = one_pass(out, text, phrases, keep if last else list(dict.fromkeys([*keep, text])), names, k > 0)
        if not last:
            out = shelf.put(out, f"block-{k}")
            if k:
                shelf.drop(f"block-{k - 1}")
    return out


def one_pass(docs: DataFrame, text: str, phrases: Phrases, keep: list[str], names: list[str], more: bool) -> DataFrame:
    """``docs`` with the findings of one block; with ``more``, joined with those that it already has."""
    held = [f"__held_{n}" for n in NEW]

    def make():
        def work(part: pa.RecordBatch) -> list:
            listed = [words(t) for t in texts(part, text)]
            spans, items = scan_shard(listed, phrases)
            items = [[phrases.items[i] for i in s] for s in items]
            if more:
                _, before, known = (part.column(part.schema.get_field_index(n)).to_pylist() for n in held)
                spans = [merge([(x["start"], x["end"]) for x in b] + s) for b, s in zip(before, spans, strict=True)]
                items = [list(dict.fromkeys(k + i)) for k, i in zip(known, items, strict=True)]
            return [[len(d) for d in listed], [[{"start": b, "end": e} for b, e in s] for s in spans], items]

        return work

    fields = [T.StructField(n, kind) for n, kind in zip(names, NEW.values(), strict=True)]
    if more:
        docs = docs.withColumnsRenamed(dict(zip(names, held, strict=True)))
    return append_columns(docs, text, fields, make, keep, held if more else ())


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document stand in a window of ten words of a benchmark item."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


SQL = {
    "op1_decontaminate": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, m)),
o AS (SELECT g.r, g.k, g.n, p.item FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM o) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r""",
}
