"""Operators over documents against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bytecnn, decontaminate, exactdedup, langid, licenses, quality, secrets, sharding
from strandloom.llm.bytecnn import averaged, chunked

RNG = random.Random(4)
WORDS = [f"w{k}" for k in range(40)] + ["été", "Straße", "MIT", "License", "cc", "BY", "NC"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "Word"), (6, "word"), (6, "word"), (7, prose(30_000)), (8, "\x00a\x00"), (9, "ÀÉ ünïcode 漢字 \U0001f600")]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_leaks(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, phrase in items:
        p = words(phrase)
        if item is None or not p:
            continue
        for k in range(max(1, len(p) - window + 1)):
            own = p[k : k + window]
            for at in range(len(w) - len(own) + 1):
                if w[at : at + len(own)] == own:
                    hit.update(range(at, at + len(own)))
                    found.add(str(item))
    return len(w), len(hit), found


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_leaks(spark, frame, block_bytes):
    items = [(1, prose(14)), (2, "w1 w2"), (3, None), (4, ""), (None, prose(12)), (5, prose(10)), (5, prose(11)), (6, "W1 W2 w3"), (7, prose(10).upper())]
    docs = ODD[:7] + ODD[8:] + [(20 + k, f"{prose(20)} {t or ''}! {prose(5)}") for k, (_, t) in enumerate(items)] + [(40, items[0][1] + " " + items[0][1]), (41, prose(2000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(frame(docs), bench, block_bytes=block_bytes)
    assert found.columns == ["doc_id", "text", "score", "shard", "n_words", "hit_spans", "hit_items"]
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        got = (r.n_words, sum(e - b for b, e in r.hit_spans), set(r.hit_items))
        assert got == brute_leaks(r.text, items), r.doc_id
        assert len(set(r.hit_items)) == len(r.hit_items)
    assert decontaminate.find_leaks(frame(docs), bench.limit(0)).where("size(hit_spans) > 0").isEmpty()
    assert decontaminate.find_leaks(frame(docs).limit(0), bench).isEmpty()


def test_leaks_of_many_blocks_keep_clashing_columns_apart(spark):
    bench = spark.createDataFrame([(k, prose(12)) for k in range(30)] + [(0, prose(12))], "item_id long, text string")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(k, f"{prose(5)} {items[k % 31][1]} {items[(k * 7) % 31][1]}") for k in range(40)] + [(99, None)]
    docs = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, N_Words long, HIT_SPANS long, `a.b` string").repartition(3)
    found = decontaminate.find_leaks(docs, bench, block_bytes=500)
    assert found.columns == ["doc_id", "text", "a.b", "n_words", "hit_spans", "hit_items"]
    got = {r.doc_id: (r.n_words, sum(e - b for b, e in r.hit_spans), set(r.hit_items)) for r in found.collect()}
    assert got == {k: brute_leaks(t, items) for k, t in rows}
    assert decontaminate.find_leaks(docs, bench, keep=["doc_id"], block_bytes=500).columns == ["doc_id", "n_words", "hit_spans", "hit_items"]


def test_index_is_exact():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        text = rng.integers(0, 4, n)
        text[-1] = 0
        if n > 1:
            text[0] = 1
        index = decontaminate.FMIndex(text, 3)
        for length in (1, 2, 3, 5):
            phrases = rng.integers(1, 4, (30, length))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [k for k in range(n - length + 1) if (text[k : k + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_secrets(frame):
    key, token = "AKIA" + "A1B2C3D4E5F6G7H8", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    docs = ODD + [
        (30, f"password=token: abcdef SECRET : '{token}' é {key} api-key=xyzzyx apikey=12345"),
        (31, f"AKIAAKIA {key}x {token[:23]} {token[:24]} ſecret=abcdefgh"),
        (32, "token=" + "Zq3" * 5000),
        (33, f"key Zk8Qw3Lm9Xv2Bn7Tr5Yp1Cd6 example{token} {'ab' * 30}"),
    ]
    for r in secrets.scan_secrets(frame(docs)).collect():
        t = r.text or ""
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(t) if len(m[0]) >= 24]
        got = [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.base_secrets]
        assert got == sorted(want)
        assert set(map(tuple, r.base_secrets)) <= set(map(tuple, r.secrets))
        own = [t[s.start : s.end] for s in r.secrets if s.kind == "entropy"]
        if r.doc_id == 33:
            assert own == ["Zk8Qw3Lm9Xv2Bn7Tr5Yp1Cd6"]
    assert secrets.digest([]) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("run", ["ab" * 30, "0123456789abcdef" * 3, "Zk8Qw3Lm9Xv2Bn7Tr5Yp1Cd6", "a" * 19])
def test_sliding_entropy(run):
    n = secrets.WINDOW
    covered = set()
    for k in range(len(run) - n + 1):
        p = np.unique(list(run[k : k + n]), return_counts=True)[1] / n
        if -(p * np.log2(p)).sum() > 3.0 + 1e-9:
            covered.update(range(k, k + n))
    assert {x for b, e in secrets.dense_spans(run, 3.0) for x in range(b, e)} == covered


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact_copies(frame, hash_bytes):
    long = prose(5000)
    docs = ODD + [(50 + k, long) for k in range(5)] + [(60, long.upper()), (61, long + "x"), (62, "É"), (63, "é")]
    groups = {}
    for k, t in docs:
        groups.setdefault(lower(t), []).append(k)
    rows = exactdedup.find_copies(frame(docs), hash_bytes=hash_bytes).collect()
    assert len(rows) == len(docs)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max(ks), len(ks)) for t, ks in groups.items()}
    assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in rows)
    assert {(r.doc_id, r.text_sha256) for r in rows} == {(k, hashlib.sha256(lower(t).encode()).hexdigest()) for k, t in docs}
    assert exactdedup.find_copies(frame([])).isEmpty()


def test_chunks_depend_on_their_text_only():
    a, b = prose(3000).encode(), prose(2000).encode()
    assert exactdedup.cut([a, b"", b]) == [exactdedup.cut([a])[0], [], exactdedup.cut([b])[0]]
    assert b"".join(exactdedup.cut([b"x" * 100_000])[0]) == b"x" * 100_000
    shared = set(exactdedup.cut([a])[0]) & set(exactdedup.cut([b"new start " + a])[0])
    assert len(shared) > len(exactdedup.cut([a])[0]) // 2


def test_sharding(frame, tmp_path, spark):
    docs = ODD + [(None, "no key")] + [(100 + k, prose(k % 50)) for k in range(500)]
    mixed = sharding.external_shuffle(frame(docs), bucket_bytes=200)
    rows = mixed.collect()
    assert set(mixed.columns) == {"doc_id", "text", "score", "hit_spans", "shard", "grown_shard", "slot"}
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((k or -1, t or "") for k, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.external_shuffle(frame(docs), bucket_bytes=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order, key=str)
    sharding.write_shards(mixed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(docs)
    assert sharding.external_shuffle(frame([])).isEmpty()


def test_licenses(frame):
    notice = next(iter(licenses.NOTICES))
    reworded = notice.replace("granted free", "granted entirely free").title()
    docs = ODD + [(70, "Licensed under CC BY-NC 4.0. The MIT License; mit license"), (71, "GNU\nGeneral-Public License gnu general public"), (72, f"x {reworded} y"), (73, " ".join(notice.split()[:8])), (74, "gnu lesser general public license")]
    rows = licenses.scan_licenses(frame(docs)).collect()
    assert len(rows) == len(docs)
    wanted = sorted((k or 0, len(words(t)), sorted(licenses.brute_places(t, licenses.BASE | licenses.PHRASES))) for k, t in docs)
    got = sorted((r.doc_id or 0, r.n_words, sorted((p.label, p.start) for p in r.places if p.kind != "notice")) for r in rows)
    assert got == wanted
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[72] == ["mit-notice"]
    assert labels[73] == []
    assert labels[70] == ["cc-by", "cc-by-nc", "mit"]
    assert licenses.scan_licenses(frame([])).isEmpty()


def corpus(n):
    """Two languages of their own letters; low quality shouts."""
    out = []
    for k in range(n):
        letters = "abcdefg" if k % 2 else "mnopqrs"
        text = " ".join("".join(RNG.choice(letters) for _ in range(5)) for _ in range(RNG.randrange(20, 200)))
        bad = k % 3 == 0
        out.append((k, text.upper().replace(" ", "!! ") if bad else text, "xx" if k % 2 else "yy", int(not bad)))
    return out


def test_convolution_and_gradients(monkeypatch):
    """Responses against loops over every place, gradients against differences of the loss."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(bytecnn, "BLOCK", 3)
    net = bytecnn.ByteCNN(3, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["bias"] = rng.normal(0, 0.5, bytecnn.FILTERS)
    codes = rng.integers(0, 256, (7, 20)).astype(np.uint8)
    want = np.full((7, bytecnn.FILTERS), -np.inf)
    for n in range(7):
        at = 0
        for width, filters in bytecnn.WIDTHS:
            for f in range(at, at + filters):
                for p in range(20 - bytecnn.SPAN + 1):
                    response = sum(float(net.p["emb"][codes[n, p + j]] @ net.p["conv"][j * bytecnn.DIM : (j + 1) * bytecnn.DIM, f]) for j in range(width))
                    want[n, f] = max(want[n, f], response)
            at += filters
    assert np.allclose(net.features(codes), np.maximum(want + net.p["bias"], 0), atol=1e-6)

    groups, labels = [codes[:2], codes[2:6], codes[6:]], np.array([0, 2, 1])

    def loss():
        feats = np.stack([net.features(g).mean(axis=0) for g in groups])
        return -np.log(bytecnn.softmax(net.logits(feats))[np.arange(3), labels]).mean() + 0.5e-4 * (net.p["dense"] ** 2).sum()

    grads = net._gradients(groups, labels)
    for name, g in grads.items():
        value = net.p[name].reshape(-1)
        where = np.argsort(-np.abs(np.asarray(g).reshape(-1)))[:12]
        for k in where.tolist():
            old = value[k]
            value[k] = old + 1e-5
            high = loss()
            value[k] = old - 1e-5
            low = loss()
            value[k] = old
            assert abs((high - low) / 2e-5 - np.asarray(g).reshape(-1)[k]) < 1e-5, (name, k)


def test_samples_hold_whole_texts(spark):
    rows = [(k % 40, f"l{k % 3}", "é" * k) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, y string, t string").repartition(5)
    drawn = langid.bounded_sample(df, "y", ["k", "t"], 20).collect()
    assert {y: sum(r.y == y for r in drawn) for _, y, _ in rows} == {"l0": 20, "l1": 20, "l2": 20}
    some = langid.bounded_bytes(spark.createDataFrame(drawn), "y", "t", ["k", "t"], 2000).collect()
    for y in ("l0", "l1", "l2"):
        own = [len(r.t.encode()) for r in some if r.y == y]
        assert sum(own) >= 2000 and sum(own) - max(own) < 2000 + max(own)
    assert {(r.k, r.y, r.t) for r in some} <= set(rows)
    one = langid.bounded_bytes(spark.createDataFrame(drawn), "y", "t", ["k", "t"], 1).collect()
    assert sorted(r.y for r in one if r.t) >= ["l0"]


def test_networks_learn_held_out_rows(spark, frame, tables):
    rows = corpus(600)
    docs = spark.createDataFrame([(k, t, lang, "s") for k, t, lang, _ in rows] + [(10_000, None, None, None), (10_001, "123 !", None, "s"), (10_002, "", "xx", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, _, q in rows] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    sf = tables(documents=docs, labels=labels)
    found = {r.doc_id: r for r in langid.op2_langid(spark, sf).collect()}
    assert len(found) == 603
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, *_ in rows)
    assert sum(found[k].lang_pred == lang for k, _, lang, _ in held) >= 0.97 * len(held)
    assert [found[k].lang_pred for k in (10_000, 10_001, 10_002)] == ["und"] * 3
    scored = {r.doc_id: r for r in quality.op3_quality(spark, sf).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(scored[k].predicted == q for k, _, _, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.values())


def test_networks_without_labels(spark, frame):
    net, classes = langid.fit_languages(frame([]).withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in langid.predict_languages(frame(ODD), net, classes).collect()} == {"und"}
    none = quality.fit_quality(frame(ODD), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score_quality(frame(ODD), none).collect()} == {0.5}


def test_chunks_cover_texts():
    texts = ["", "a" * 10, "é" * 700, "b" * 5000]
    codes, owner, weight = chunked(texts, 64, 61)
    for k, t in enumerate(texts):
        raw, own = t.encode(), codes[owner == k]
        back = bytearray((len(own) - 1) * 61 + 64)
        for j, c in enumerate(own):
            back[j * 61 : j * 61 + 64] = c.tobytes()
        assert bytes(back[: len(raw)]) == raw
        assert len(own) == max(1, -(-(len(raw) - 64) // 61) + 1 if len(raw) > 64 else 1)
    assert averaged(np.ones((len(codes), 1)), owner, weight, 4).tolist() == [[1.0]] * 4
