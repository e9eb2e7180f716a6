"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

A window starts with what is left of a document, or with the next unused one (the
seed); the seed's best unused neighbours by BM25 follow until the window is
full. A document that crosses the end of the window is cut there, and its rest
seeds the next window. So all windows but a shard's last hold exactly ``WINDOW``
tokens; the last is cut into powers of two, which need no padding.

The inverted index is sharded by content. The weights are those of the whole
corpus: one pass counts its documents, its words, and in how many documents each
slot of hashed words occurs. A second pass gives each document a place on a line,
by weighted minima of its words' hashes, so that documents with the same heavy
words are close; cuts of that line, quantiles of a sample, deal the documents to
partitions, where they are sorted by place, key and text and taken in shards
that fit in memory. A seed asks its own shard's index. Shards depend on the rows,
not on how the input is split.

Nothing grows with the corpus but the cuts, eight bytes for a partition. A place
ends in bits of the key's and text's hash, so a group of copies is spread over as
many partitions as its size asks for.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, table

WINDOW = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
SEED = 6
#: Documents and bytes of text of a shard, which are in memory at once; a longer text is alone.
SHARD_DOCS, SHARD_BYTES = 1500, 6 << 20
#: Bytes of text of a partition, and the most partitions; beyond that each holds more shards.
PART_BYTES, MOST_PARTS = 4 << 20, 1 << 16
#: Documents sampled for each cut.
SAMPLED = 64
#: Hashed words are counted in so many slots; words that share one share its count.
SLOTS = 1 << 20
#: Counts move in so many blocks of slots.
BLOCKS = 1024
#: Words that decide a document's place.
PLACES = 3
#: Terms held as dense rows: the most, and the share of a shard's documents that each has.
DENSE_TERMS, DENSE_SHARE = 1500, 0.06
#: Entries of light terms' lists that are summed at once.
SCORED = 4 << 20
K1, B = 1.2, 0.75
#: Bytes of a piece of text that is encoded once for all its places; texts with longer ones are encoded whole.
LONGEST = 400
#: Pieces that are encoded in one call.
AT_ONCE = 4096
#: Pieces and ids that a worker remembers; beyond that, those that only one shard had go.
REMEMBERED, REMEMBERED_IDS = 1 << 19, 1 << 21
#: How texts are cut before merging; fixed value of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts the same where no two characters of white space meet and none ends the text; without
#: the look ahead it is matched in linear time and several times as fast.
PLAIN_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")

_U64 = np.uint64
#: White space of more than one byte, and U+180E, in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


class Hasher:
    """64-bit hashes of many spans of a buffer at once, from the prefix sums of one
    polynomial modulo 2**64, taken in blocks."""

    BLOCK = 1 << 18

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.table = rng.integers(0, (1 << 64) - 1, 256, dtype=_U64, endpoint=True)
        base = 0x9E3779B97F4A7C15
        self.up, self.down = (np.cumprod(np.append(_U64(1), np.full(self.BLOCK - 1, x, _U64))) for x in (base, pow(base, -1, 1 << 64)))
        self.far_up, self.far_down = pow(base, self.BLOCK, 1 << 64), pow(base, -self.BLOCK, 1 << 64)

    def __call__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of spans in order, none empty beyond the buffer's end."""
        low, high = np.zeros(len(starts), _U64), np.zeros(len(starts), _U64)
        total, up, held = np.zeros(1, _U64), 1, np.empty(self.BLOCK + 1, _U64)
        for at in range(0, len(buffer), self.BLOCK):
            part = buffer[at : at + self.BLOCK]
            sums = held[: len(part) + 1]
            np.take(self.table, part, out=sums[1:], mode="clip")
            sums[1:] *= self.up[: len(part)]
            np.cumsum(sums[1:], out=sums[1:])
            sums[1:] *= _U64(up)
            sums[1:] += total
            sums[0] = total[0]
            for out, where in ((low, starts), (high, ends)):
                a, b = np.searchsorted(where, (at, at + len(part) + 1))
                out[a:b] = sums[where[a:b] - at]
            total, up = sums[-1:].copy(), up * self.far_up % (1 << 64)
        far = np.array([pow(self.far_down, k, 1 << 64) for k in range(len(buffer) // self.BLOCK + 1)], _U64)
        back = self.down[starts % self.BLOCK] * far[starts // self.BLOCK]
        return mixed((high - low) * back + (ends - starts).astype(_U64) * _U64(0xA24BAED4963EE407))


def words_of(raw: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of some texts: runs of other than blanks and control characters."""
    buffer = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    inside = buffer > 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begin = np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))
    return np.repeat(np.arange(len(raw)), np.diff(begin)), hasher(buffer, starts, ends)


@functools.lru_cache(2)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.lru_cache(2)
def load_merger(path: str):
    """The same vocabulary for tiktoken, which merges words several times as fast, for
    texts that are not ``irregular``; None if the file is not a byte-level BPE with
    ``PATTERN`` whose ids follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole["pre_tokenizer"] or {}
    special = {x["content"] for x in whole["added_tokens"]}
    vocabulary = {t: k for t, k in model["vocab"].items() if t not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ordered = [vocabulary.get(m, -1) for m in merges]
    same = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    same &= (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True), whole["normalizer"]) == ("ByteLevel", False, True, None)
    if not same or ordered != list(range(256, 256 + len(merges))) or len(vocabulary) != 256 + len(merges):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items()}
    return tiktoken.Encoding("pieces", pat_str=PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash occurs first, and the number of each one, as far as
    the upper bits tell: the lower ones carry the places, so that one sort does."""
    low = _U64((1 << max(1, (len(h) - 1).bit_length())) - 1)
    keys = np.sort((h & ~low) | np.arange(len(h), dtype=_U64))
    order = (keys & low).astype(np.int64)
    keys &= ~low
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def irregular(raw: list[bytes]) -> np.ndarray:
    """Which texts have white space other than single blanks and line ends between
    other characters, control characters, or a long piece between blanks."""
    joined = b"\n".join([b"", *raw, b""])
    buffer = np.frombuffer(joined, np.uint8)
    first = np.cumsum([1, *(len(r) + 1 for r in raw)])
    out = np.zeros(len(raw) + 1, bool)
    white = buffer <= 32
    twice = np.flatnonzero(white[:-1] & white[1:])
    for at in (twice, twice + 1, np.flatnonzero((buffer < 32) & (buffer != 10))):
        own = np.searchsorted(first, at, side="right") - 1
        own, at = own[own >= 0], at[own >= 0]
        out[own[at < first[np.minimum(own + 1, len(raw))] - 1]] = True
    cuts = np.sort(np.concatenate((first - 1, np.flatnonzero(buffer == 32))))
    long = cuts[:-1][np.diff(cuts) > LONGEST]
    out[np.searchsorted(first - 1, long, side="right") - 1] = True
    if any(w[:2] in joined for w in dict.fromkeys(w[:2] for w in _WIDE)):
        for k, r in enumerate(raw):
            out[k] |= any(w in r for w in _WIDE)
    return out[:-1]


class Encoder:
    """Token ids of texts, as the tokenizer of ``path`` gives them. A byte-level
    BPE with this pattern never merges over a single blank between two other
    characters, which begins a token with what follows; so texts are split there,
    and each distinct piece of a shard is encoded once, many in one call: the
    tokens' lengths in bytes tell where a piece ends. A worker remembers the ids of
    pieces for its next shards, which changes the cost alone; a piece is taken for a
    known one as for another of its shard, if hash, length and both ends agree."""

    KNOWN = np.dtype([("key", "u8"), ("head", "u8"), ("tail", "u8"), ("first", "u4"), ("shards", "u4"), ("length", "u2"), ("size", "u2")])

    def __init__(self, path: str):
        self.tokenizer, self.merger, self.hasher = load_tokenizer(path), load_merger(path), Hasher()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes[k] = len(token)  # a byte-level token has a character for each byte
        self.known, self.ids = np.zeros(0, self.KNOWN), np.zeros(0, np.uint32)  # by key; the ids of all

    @staticmethod
    @functools.lru_cache(2)
    def of(path: str) -> Encoder:
        """One for all tasks of a worker."""
        return Encoder(path)

    def direct(self, raw: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]

    def follow(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of distinct pieces, each with the blank before it, and how many each has."""
        out = []
        for k in range(0, len(pieces), AT_ONCE):
            own = pieces[k : k + AT_ONCE]
            ids = np.array(self.merger.encode_ordinary((b" " + b" ".join(own)).decode()), np.uint32)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            reached = np.cumsum(self.bytes[ids])
            last = np.searchsorted(reached, ends)
            if last[-1] >= len(ids) or (reached[last] != ends).any():  # never seen; a token would span a blank
                each = self.direct([b" " + p for p in own])
                ids, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            out.append((ids, np.diff(last, prepend=-1)))
        return out

    def encode(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = irregular(raw) if self.merger is not None else np.ones(len(raw), bool)
        whole = np.flatnonzero(odd).tolist()
        own = [k for k in np.flatnonzero(~odd).tolist() if raw[k]]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(raw)
        if own:
            flat = b" ".join([raw[k] for k in own])
            buffer = np.frombuffer(flat, np.uint8)
            blanks = np.flatnonzero(buffer == 32)
            starts, ends = np.append(0, blanks + 1), np.append(blanks, len(flat))
            begin = np.searchsorted(starts, np.cumsum([0, *(len(raw[k]) + 1 for k in own)]))  # pieces before each text
            h = self.hasher(buffer, starts, ends)
            h[begin[:-1]] = ~h[begin[:-1]]  # no blank comes before it
            marks = self.marks(flat, starts, ends)
            place, which = distinct(h)
            if not self.agree(marks, place[which]):  # by all bits of the hashes
                _, place, which = np.unique(h, return_index=True, return_inverse=True)
                if not self.agree(marks, place[which]):
                    whole, own = list(range(len(raw))), []
        if own:
            leads = np.zeros(len(starts), bool)
            leads[begin[:-1]] = True
            first, n = self.find(flat, starts[place], leads[place], h[place], [m[place] for m in marks])
            first, n = first[which], n[which]
            before = np.cumsum(n) - n
            joined = self.ids[np.arange(int(n.sum())) + np.repeat(first - before, n)]
            for k, x in zip(own, np.split(joined, before[begin[1:-1]]), strict=True):
                out[k] = x
        for k, x in zip(whole, self.direct([raw[k] for k in whole]), strict=True):
            out[k] = x
        return out

    def find(self, flat: bytes, starts: np.ndarray, leads: np.ndarray, keys: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each of some distinct pieces begin, and how many it has."""
        if len(self.known) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        length, head, tail = marks
        at = np.searchsorted(np.ascontiguousarray(self.known["key"]), keys)
        like = np.take(self.known, at, mode="clip") if len(self.known) else np.zeros(len(keys), self.KNOWN)
        there = (like["key"] == keys) & (like["length"] == length) & (like["head"] == head) & (like["tail"] == tail)
        self.known["shards"][at[there]] += 1
        new = np.flatnonzero(~there)
        new = new[np.argsort(leads[new], kind="stable")]  # those with a blank before them first
        pieces = [flat[a:b] for a, b in zip(starts[new].tolist(), (starts[new] + length[new]).tolist(), strict=True)]
        n_after = len(pieces) - int(leads[new].sum())
        found = [(self.ids, np.zeros(0, np.int64)), *self.follow(pieces[:n_after])]
        for p in pieces[n_after:]:
            ids = np.array(self.merger.encode_ordinary(p.decode()), np.uint32)
            found.append((ids, np.array([len(ids)])))
        first, size = like["first"].astype(np.int64), like["size"].astype(np.int64)
        size[new] = np.concatenate([n for _, n in found])
        first[new] = np.cumsum(size[new]) - size[new] + len(self.ids)
        self.ids = np.concatenate([i for i, _ in found])
        more = np.zeros(len(new), self.KNOWN)
        for name, x in (("key", keys), ("head", head), ("tail", tail), ("first", first), ("length", length), ("size", size)):
            more[name] = x[new]
        more["shards"] = 1
        more = more[np.argsort(more["key"])]
        self.known = np.insert(self.known, np.searchsorted(np.ascontiguousarray(self.known["key"]), more["key"]), more)
        return first, size

    def forget(self) -> None:
        """Keep the pieces of more than one shard, those of the most shards if they are too many."""
        keep = np.argsort(-self.known["shards"].astype(np.int64), kind="stable")[: REMEMBERED // 2]
        keep = keep[(self.known["shards"][keep] > 1) & (np.cumsum(self.known["size"][keep], dtype=np.int64) <= REMEMBERED_IDS // 2)]
        self.known = self.known[np.sort(keep)]
        n = self.known["size"].astype(np.int64)
        first = np.cumsum(n) - n
        self.ids = self.ids[np.arange(int(n.sum())) + np.repeat(self.known["first"] - first, n)]
        self.known["first"] = first
        self.known["shards"] >>= 1

    @staticmethod
    def marks(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece's length and its first and last eight bytes, the last ones of longer pieces alone."""
        eight = np.ndarray(len(flat) + 9, "<u8", bytes(8) + flat + bytes(8), strides=(1,))
        n = ends - starts
        keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U64)[np.minimum(n, 8)]
        return n, eight[starts + 8] & keep, np.where(n > 8, eight[ends], _U64(0))

    @staticmethod
    def agree(marks: tuple[np.ndarray, ...], like: np.ndarray) -> bool:
        """Whether each piece has the marks of the one it is taken for."""
        return all(bool((m == m[like]).all()) for m in marks)


class Weights:
    """What BM25 needs of the whole corpus."""

    def __init__(self, documents: int, words: int, df: np.ndarray):
        self.mean = max(1.0, words / max(1, documents))
        #: A slot of half the documents or more weighs nothing.
        self.idf = np.maximum(0, np.log((documents - df + 0.5) / (df + 0.5))).astype(np.float32)

    def of(self, slot: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


class Scores:
    """Rows of the matrix of what BM25 gives each document of a shard for the terms of
    each, itself 0. Few documents seed a window, so a row is made when it is asked for.

    An inverted index from terms to documents; the lists of frequent terms are
    dense rows. Copies get equal scores, as each document's are summed in one order.
    """

    dtype = np.dtype(np.float32)

    def __init__(self, row: np.ndarray, h: np.ndarray, n: int, weights: Weights):
        low = _U64((1 << max(1, (n - 1).bit_length())) - 1)
        keys, tf = counted((h & ~low) | row.astype(_U64))  # the upper bits tell terms apart
        doc, keys = (keys & low).astype(np.int64), keys & ~low
        term = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1]))) if len(keys) else doc
        weight = weights.of(slot(keys), tf, np.bincount(row, minlength=n)[doc]).astype(np.float32)
        df = np.bincount(term)
        keep = (df[term] > 1) & (weight > 0)  # a term of one document finds no neighbour
        term, doc, weight = term[keep], doc[keep], weight[keep]
        df = np.bincount(term)
        heavy = np.flatnonzero(df > DENSE_SHARE * n)
        heavy = heavy[np.argsort(-df[heavy], kind="stable")[:DENSE_TERMS]]
        place = np.full(len(df), -1)
        place[heavy] = np.arange(len(heavy))
        place = place[term]
        own = place >= 0
        self.n = n
        self.dense = np.zeros((len(heavy), n), np.float32)
        self.dense[place[own], doc[own]] = weight[own]
        self.rows, self.rows_begin = self.by_document(doc[own], place[own])
        self.held = np.empty((max([0, *np.diff(self.rows_begin)]), n), np.float32)
        # Of each light term its documents, with their weights.
        term, self.doc, self.weight = term[~own], doc[~own], weight[~own]
        df = np.bincount(term)
        self.first, self.size = np.cumsum(df) - df, df
        self.terms, self.terms_begin = self.by_document(self.doc, term)

    def by_document(self, doc: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """``what`` in the order of documents, and where each document's begins."""
        order = np.argsort(doc.astype(np.min_scalar_type(self.n)), kind="stable")
        return what[order], np.cumsum([0, *np.bincount(doc, minlength=self.n)]).tolist()

    def __getitem__(self, seed: int) -> np.ndarray:
        rows = self.rows[self.rows_begin[seed] : self.rows_begin[seed + 1]]
        out = np.take(self.dense, rows, axis=0, out=self.held[: len(rows)], mode="clip").sum(axis=0) if len(rows) else np.zeros(self.n, np.float32)
        terms = self.terms[self.terms_begin[seed] : self.terms_begin[seed + 1]]
        done, at = np.cumsum(self.size[terms]), 0
        while at < len(terms):
            before = int(done[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(done, before + SCORED, side="right")))
            s, f = self.size[terms[at:end]], self.first[terms[at:end]]
            hits = np.arange(before, int(done[end - 1])) + np.repeat(f - done[at:end] + s, s)
            out += np.bincount(self.doc[hits], self.weight[hits], self.n).astype(np.float32)
            at = end
        out[seed] = 0
        return out

    def tolist(self) -> list[list[float]]:
        return [self[k].tolist() for k in range(self.n)]


def scores(row: np.ndarray, h: np.ndarray, n: int, weights: Weights) -> Scores:
    """(n, n): the scores of a shard's documents, from the row and hash of every word."""
    return Scores(row, h, n, weights)


def pack_shard(lengths: list[int], near: np.ndarray | Scores, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, first id, ids). ``near`` has a row of scores for each
    document; of equal scores the first document is taken, and one of 0 is no neighbour."""
    free = np.ones(len(lengths), near.dtype)
    sequences: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room = window

    def put(doc: int) -> None:
        nonlocal now, room
        free[doc] = 0
        start, end = 0, lengths[doc]
        while start < end:
            n = min(room, end - start)
            now.append((doc, start, n))
            start, room = start + n, room - n
            if not room:
                sequences.append(now)
                now, room = [], window

    for seed in range(len(lengths)):
        if not free[seed]:
            continue
        put(seed)
        while now:  # a window is open; its last document seeds it
            closed, found = len(sequences), near[now[-1][0]]
            while len(sequences) == closed:
                left = found * free
                best = int(left.argmax())
                if not left[best] > 0:
                    break
                put(best)
            else:
                continue
            break  # no neighbour is left; the next unused document goes on
    return sequences + (powers(now) if now else [])


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One sequence cut into sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in pieces)
    out: list[list[tuple[int, int, int]]] = []
    rest = list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        room = 1 << bit
        if not total & room:
            continue
        own = []
        while room:
            doc, start, n = rest.pop(0)
            take = min(n, room)
            own.append((doc, start, take))
            if take < n:
                rest.insert(0, (doc, start + take, n - take))
            room -= take
        out.append(own)
    return out


def corpus_weights(rows: DataFrame) -> tuple[Weights, int, int]:
    """The corpus's weights, its number of documents and its bytes of text, from one
    narrow pass: a task sends its counts in ``BLOCKS`` blocks of slots at most, and one
    of sums. They are added where a block's counts meet, one array for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, df, sums = Hasher(), np.zeros(SLOTS, np.int64), np.zeros(3, np.int64)
        for b in batches:
            for part in slices(b, "text"):
                raw = part.column(part.schema.get_field_index("text")).to_pylist()
                row, h = words_of(raw, hasher)
                df += np.bincount(counted(row * SLOTS + slot(h))[0] % SLOTS, minlength=SLOTS)
                sums += [len(raw), len(row), sum(map(len, raw))]
        met = {k: own for k, own in enumerate([*df.reshape(BLOCKS, -1), sums]) if own.any()}
        yield blocks(met)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(own, np.int64)
        yield blocks(held)

    def blocks(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "n"])

    kinds = "block int, n binary"
    found = rows.select("text").mapInArrow(run, kinds).repartition("block").mapInArrow(add, kinds).toArrow()
    met = {k: np.frombuffer(n, np.int64) for k, n in zip(found["block"].to_pylist(), found["n"].to_pylist(), strict=True)}
    none = np.zeros(SLOTS // BLOCKS, np.int64)
    documents, words, size = map(int, met.get(BLOCKS, np.zeros(3, np.int64)))
    return Weights(documents, words, np.concatenate([met.get(k, none) for k in range(BLOCKS)])), documents, size


@functools.lru_cache(1)
def draws() -> np.ndarray:
    """An exponential number for each slot and each of ``PLACES`` draws."""
    return np.random.default_rng(SEED + 1).exponential(size=(PLACES, SLOTS)).astype(np.float32)


def places(raw: list[bytes], ties: np.ndarray, weights: Weights, hasher: Hasher, drawn: np.ndarray) -> np.ndarray:
    """Each document's place on the line: 16 bits each of the words that win ``PLACES``
    draws weighted by BM25, and 16 bits of ``ties``."""
    row, h = words_of(raw, hasher)
    lengths = np.bincount(row, minlength=len(raw))
    pairs, tf = counted(row * SLOTS + slot(h))
    doc, term = pairs // SLOTS, pairs % SLOTS
    weight = weights.of(term, tf, lengths[doc])
    doc, term, weight = doc[weight > 0], term[weight > 0], weight[weight > 0]
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.zeros((len(raw), PLACES + 1), np.uint16)
    for k in range(PLACES):
        wait = drawn[k, term] / weight
        least = np.minimum.reduceat(wait, begin) if len(begin) else wait
        won = np.flatnonzero(wait == np.repeat(least, np.diff(begin, append=len(wait))))
        own, at = np.unique(doc[won], return_index=True)
        out[own, k] = mixed(term[won[at]].astype(_U64) + _U64(1)) & _U64(0xFFFF)
    out[:, PLACES] = ties & 0xFFFF
    return out.astype(_U64) @ np.array([1 << 16 * (PLACES - k) for k in range(PLACES + 1)], _U64)


def placed(rows: DataFrame, weights: Weights, cuts: np.ndarray | None) -> DataFrame:
    """Key, text, tie, place and partition of each row; without ``cuts`` place alone."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, cuts))
    kinds = T.StructType([rows.schema["key"], rows.schema["text"], T.StructField("place", T.LongType()), T.StructField("part", T.IntegerType())][0 if cuts is not None else 2 : 4 if cuts is not None else 3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = sent.value
        hasher, drawn = Hasher(), draws()
        for b in batches:
            for part in slices(b, "text"):
                raw = part.column(1).to_pylist()
                place = places(raw, part.column(2).to_numpy(), weights, hasher, drawn)
                # The order of unsigned places, as signed ones.
                columns = [pa.array((place ^ _U64(1 << 63)).view(np.int64))]
                if cuts is not None:
                    columns = [part.column(0), part.column(1), *columns, pa.array(np.searchsorted(cuts, place, side="right").astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return rows.select("key", "text", "tie").mapInArrow(run, kinds)


def cut_places(rows: DataFrame, weights: Weights, documents: int, size: int) -> np.ndarray:
    """Where the line is cut into partitions: quantiles of a sample of the documents by
    a hash of key and text, about ``SAMPLED`` for each partition."""
    n = min(MOST_PARTS, -(-size // PART_BYTES))
    if n < 2:
        return np.zeros(0, _U64)
    rate = min(1.0, SAMPLED * n / documents)
    some = rows.where(F.pmod(F.shiftright("tie", 20), F.lit(1 << 30)) < int(rate * (1 << 30)))
    found = placed(some, weights, None).groupBy("place").agg(F.count("*").alias("n")).toArrow().sort_by("place")
    place, count = found["place"].to_numpy().view(_U64) ^ _U64(1 << 63), np.cumsum(found["n"].to_numpy())
    if not len(place):
        return np.zeros(0, _U64)
    return np.unique(place[np.searchsorted(count, np.arange(1, n) * count[-1] / n)])


def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the ids themselves if asked for.

    Null texts are empty and hold the end id alone; texts without words are
    no one's neighbours and are taken in their order. Null keys are kept. Repeated
    rows are packed each. sequence_id is unique (partition and number); offsets
    are gapless. A very long text fills as many windows as it needs. An empty
    table has no rows.
    """
    small_batches(docs.sparkSession)
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in names[1:7])] + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.lit(SEED), "key", "text"))
    weights, documents, size = corpus_weights(rows)
    cuts = cut_places(rows, weights, documents, size)
    dealt = placed(rows, weights, cuts).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("place", "key", "text")
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        keys, held, size = [], [], 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (len(held) >= SHARD_DOCS or size + len(t) > SHARD_BYTES):
                    yield keys, held
                    keys, held, size = [], [], 0
                keys.append(k)
                held.append(t)
                size += len(t)
        if held:
            yield keys, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = [f.type for f in to_arrow_schema(kinds)]
        encoder, sequence = Encoder.of(tokenizer_path), TaskContext.get().partitionId() << 40
        for keys, raw in shards(batches):
            ids = [np.append(i, END).astype("<u4") for i in encoder.encode(raw)]
            near = scores(*words_of(raw, encoder.hasher), len(raw), sent.value)
            out: list[list] = [[] for _ in names]
            for own in pack_shard([len(i) for i in ids], near, window):
                offset = 0
                for doc, start, n in own:
                    piece = ids[doc][start : start + n]
                    row = (keys[doc], start, n, zlib.crc32(piece.tobytes()), len(ids[doc]), sequence, offset)
                    for c, v in zip(out, row if not with_ids else (*row, piece.tolist()), strict=True):
                        c.append(v)
                    offset += n
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, arrow, strict=True)], names)

    return dealt.select("key", "text").mapInArrow(run, kinds)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most ``WINDOW``."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
