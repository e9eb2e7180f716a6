"""The registered queries, run over small tables and held against brute force."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

import __spark_entry__
from strandloom.llm import licenses, secrets

RNG = random.Random(12)
WORDS = [f"w{k}" for k in range(60)] + ["MIT", "License", "cc", "by"]
KEY = "AKIA" + "A1B2C3D4E5F6G7H8"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def documents():
    rows = [(k, prose(RNG.randrange(1, 120))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "ONE"), (105, prose(12_000)), (106, "\x00x 漢字 é"), (107, "a\n\nb")]
    rows += [(200 + k, rows[5][1].upper()) for k in range(3)] + [(210, rows[6][1] + " x"), (211, f"password=hunter22 {KEY}"), (212, f"{prose(5)} The MIT License {prose(3)}")]
    return rows


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture
def run(spark, tables):
    rows = documents()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, rows[7][1]), (2, "w1 w2 w3"), (3, None), (4, rows[105 - 45][1])]
    pages = [(k, "u", h) for k, h in enumerate([None, "", "x" * 2000, "x" * 2000, "short", "short", "é" * 700])]
    sf = tables(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"), pages=spark.createDataFrame(pages, "page_id long, url string, html string"))
    empty = spark.createDataFrame([], docs.schema)

    def call(name, none=False):
        if none:
            empty.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
            spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{sf}/pages.parquet")
        return __spark_entry__.queries()[name](spark, sf).collect()

    return rows, items, pages, call


def test_decontaminate(run):
    rows, items, _, call = run
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {r.doc_id: r for r in call("op1_decontaminate")}
    assert len(found) == len(rows)
    for k, t in rows:
        w, hit, own = word.findall(lower(t)), set(), set()
        for item, phrase in items:
            p = word.findall(lower(phrase))
            for a in range(max(1, len(p) - 9)) if p else ():
                part = p[a : a + 10]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        own.add(str(item))
        r = found[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))


def test_exact_dedup(run):
    rows, _, _, call = run
    groups = {}
    for k, t in rows:
        groups.setdefault(lower(t), []).append(k)
    want = sorted((k, max(ks), len(ks), k == max(ks), hashlib.sha256(t.encode()).hexdigest()) for t, ks in groups.items() for k in ks)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in call("op4_exact_dedup")) == want


def winner(key, shards):
    def drawn(j):
        h = 42
        for value, size in ((20, 4), (j, 4), (key, 8)):
            h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    return max(range(shards), key=lambda j: (drawn(j), j))


def test_sharding(run):
    rows, _, _, call = run
    found = call("op5_sharding")
    assert len(found) == len(rows)
    text, slots = dict(rows), {}
    for r in found:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (winner(r.doc_id, 24), winner(r.doc_id, 25))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing(run):
    rows, _, _, call = run
    pieces, sequences = {}, {}
    for r in call("op6_packing"):
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == {k for k, _ in rows}
    for own in pieces.values():
        own.sort()
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:j]) for j in range(len(own))]
        assert sum(n for _, n, _ in own) == own[0][2]
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:j]) for j in range(len(own))]
        assert total <= 2048 and total & (total - 1) == 0


def test_archives(run):
    _, _, pages, call = run
    raw = {k: (h or "").encode() for k, _, h in pages}
    last = {h: max(k for k, x in raw.items() if x == h) for h in raw.values() if len(h) >= 1000}
    want = sorted((k, len(h), hashlib.sha1(h).hexdigest(), *(("response", None) if last.get(h, k) == k else ("revisit", last[h]))) for k, h in raw.items())
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in call("op7_warc")) == want


def test_secrets(run):
    rows, _, _, call = run
    found = {r.doc_id: r for r in call("op8_secrets")}
    assert len(found) == len(rows)
    for k, t in rows:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(t) if len(m[0]) >= 24]
        r = found[k]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(x == kind for _, x, _ in base) for kind in range(3)), secrets.digest(sorted(base)))
        assert {f"{secrets.KINDS[x]}:{b}:{e}" for b, x, e in base} <= set(r.spans.split(","))
    assert found[211].n_assign == found[211].n_access == 1


def test_near_dedup(run):
    rows, _, _, call = run
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        n = min(3, len(w))
        sets[k] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b]
        if all(label[label[k]] == label[k] for k in label):
            break
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in call("op9_near_dedup")}
    assert got == {k: (len(sets[k]), label[k], label[k] == k) for k in sets}
    assert got[200][1] == 5 and got[104][1] == 103


def test_licenses(run):
    rows, _, _, call = run
    found = {r.doc_id: r for r in call("op10_licenses")}
    assert len(found) == len(rows)
    for k, t in rows:
        base = licenses.brute_places(t, licenses.BASE)
        labels = {x for x, _ in licenses.brute_places(t, licenses.BASE | licenses.PHRASES)}
        starts = [at for _, at in base]
        r = found[k]
        assert (r.n_base, r.first_word, r.last_word) == (len(base), min(starts, default=None), max(starts, default=None))
        assert (r.base_labels, r.labels, r.score) == (",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), float(bool(labels)))


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_exact_dedup", "op5_sharding", "op6_packing", "op7_warc", "op8_secrets", "op9_near_dedup", "op10_licenses"])
def test_empty_tables(run, name):
    assert run[3](name, none=True) == []
