"""Near copies, packing, archives and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandloom.llm import neardup, packing, warc

PATH = public_tokenizers.path(packing.VOCABULARY)


def near_rows():
    """One group of near copies around the threshold, small groups, and odd texts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2000)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for k in range(120):
        t = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 6])):
            t[rng.randrange(80)] = rng.choice(words)
        rows.append((k, " ".join(t)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE\n"), (204, "one two"), (205, " \t"), (206, rows[3][1].upper()), (207, rows[3][1]), (207, rows[3][1])]
    return [*rows, (208, " ".join(rng.choice(words) for _ in range(20_000)))]


def brute_components(rows, words, percent):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(words, len(w))
        sets[k] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_copies(frame, words, percent):
    rows = near_rows()
    found = neardup.near_duplicates(frame(rows), words=words, percent=percent).collect()
    assert len(found) == len(rows)
    want = brute_components(rows, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) > 8  # stars alone don't decide this group


def test_near_copies_of_nothing(frame):
    assert neardup.near_duplicates(frame([])).isEmpty()
    assert [r.component_id for r in neardup.near_duplicates(frame([(7, "a b c d e f")])).collect()] == [7]


def test_near_copies_without_keys(frame):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "x y z"), (None, "x y z"), (None, None), (None, "")]
    found = neardup.near_duplicates(frame(rows), words=3, percent=85).collect()
    assert sorted((r.n_shingles, r.component_id) for r in found if r.component_id is not None) == [(2, 1), (2, 1), (2, 1)]
    assert sorted(r.n_shingles for r in found if r.component_id is None) == [0, 0, 1, 1]


def test_a_large_group_makes_few_pairs(frame, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for k in range(300):
        t = list(base)
        t[rng.randrange(200)] = rng.choice(words)
        rows.append((k, " ".join(t)))
    counts, put = {}, neardup.Shelf.put

    def counted(self, df, name):
        out = put(self, df, name)
        if name in ("starred", "own", "further") or name.startswith("pairs"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(neardup.Shelf, "put", counted)
    found = neardup.near_duplicates(frame(rows), words=5, percent=80).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(counts.values()) <= 2 * len(rows)


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    circle = neardup.Circulant(5, 25)
    errors = []
    for _ in range(40):
        both = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = both[:250], both[50:]
        errors.append((circle.signature(a) == circle.signature(b)).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02


def test_banding_keeps_its_bound_at_every_threshold(frame):
    for percent in range(1, 101):
        rows, bands = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-6, percent
    assert (neardup.banding(85), neardup.banding(80)) == ((5, 25), (4, 32))
    with pytest.raises(ValueError):
        neardup.banding(0)
    pairs = []
    for k in range(60):  # 40 words shared of 80: at the threshold
        both = [f"s{k}x{j}" for j in range(40)]
        pairs += [(2 * k + e, " ".join(both + [f"o{k}x{e}x{j}" for j in range(20)])) for e in (0, 1)]
    found = neardup.near_duplicates(frame(pairs), words=1, percent=50).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k - k % 2 for k, _ in pairs}


def packed_rows():
    rng = random.Random(8)
    some = [f"t{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(some) for _ in range(rng.randrange(1, 400)))) for k in range(60)]
    odd = [None, "", " two  blanks ", "a\n\nb\tc", "　wide space", "it's 12,345 éà", "<|endoftext|> x", "word", "word", "x" * 5000, " ".join(some * 40)]
    return rows + [(100 + k, t) for k, t in enumerate(odd)]


def test_packing(frame):
    rows = packed_rows()
    found = packing.pack(frame(rows), PATH, with_ids=True).collect()
    plain = packing.load_tokenizer(PATH)
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    pieces, sequences = {}, {}
    for r in found:
        assert r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, want in ids.items():
        got = sorted(pieces[k])
        assert [x for _, own in got for x in own] == want
        assert [s for s, _ in got] == [sum(len(o) for _, o in got[:j]) for j in range(len(got))]
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:j]) for j in range(len(own))]
        total = sum(n for _, n in own)
        assert total <= packing.WINDOW
        assert total & (total - 1) == 0  # full, or a power of two: nothing is padded
    assert packing.pack(frame([]), PATH).isEmpty()


def test_pieces_are_encoded_as_the_tokenizer_does():
    rng = random.Random(6)
    signs = "abcdeXYZ0189'éßñ漢字\U0001f600.,;:!?-_()<|>\"\n"
    texts = [" ".join("".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(200)]
    texts += ["a\n\nb", "tab\there", " lead", "trail ", "line\nend", "two  blanks", "wide\u3000space", "thin\u2009space", "nbsp\u00a0x", "“quoted” text", "\u180ex", "p" * 500 + " q"]
    texts += ["don't we'll it's 'tis", "a 's b", "x 123abc 4.5", "<|endoftext|> a <|endoftext|>", "naïve café Ünïcödé ǅ ʰ"]
    encoder, plain = packing.Encoder(PATH), packing.load_tokenizer(PATH)
    assert encoder.merger is not None
    odd = packing.irregular([t.encode() for t in texts])
    for t, o in zip(texts, odd.tolist(), strict=True):
        white = re.search(r"\s\s|[^\S \n]|^\s|\s$|\u180e", t) is not None
        assert o == (white or max(len(x.encode()) for x in t.split(" ")) > packing.LONGEST), t
    for t, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t
    for t in ("", " ", "one", "\n\nx", "x" * 1000):
        assert encoder.encode([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert encoder.encode([]) == []


def test_pieces_that_a_hash_confuses_are_encoded_plainly():
    encoder, plain = packing.Encoder(PATH), packing.load_tokenizer(PATH)
    encoder.hasher = lambda buffer, starts, ends: (ends - starts).astype(np.uint64)
    t = "some words that differ and have equal lengths, like this or that"
    assert encoder.encode([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_pieces_are_encoded_once_for_several_shards(monkeypatch):
    encoder, plain = packing.Encoder(PATH), packing.load_tokenizer(PATH)
    rng = random.Random(12)
    some = ["".join(rng.choice("abcdé.") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    asked = []
    follow = encoder.follow
    monkeypatch.setattr(encoder, "follow", lambda pieces: asked.extend(pieces) or follow(pieces))

    def shard(words):
        texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(50)]
        for t, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids

    for _ in range(4):
        shard(some)
    assert len(asked) == len(set(asked)) <= len(some)
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    monkeypatch.setattr(packing, "REMEMBERED_IDS", 3000)
    for k in range(6):  # few are kept, and right
        shard(some[40 * k : 40 * k + 200])
        assert len(encoder.known) <= 100 + 2 * 200
        assert len(encoder.ids) == encoder.known["size"].sum() <= 3000 + 2 * 200 * 60


def test_pieces_that_a_hash_confuses_between_shards_are_told_apart():
    encoder, plain = packing.Encoder(PATH), packing.load_tokenizer(PATH)
    encoder.hasher = lambda buffer, starts, ends: np.full(len(starts), 5, np.uint64)
    for t in ("cat", "dog", "catalogues", "cat", "dogmatical", "cat"):
        assert encoder.encode([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_a_vocabulary_that_does_not_follow_its_merges_is_left_to_the_tokenizer(tmp_path):
    import json

    whole = json.load(open(PATH, encoding="utf-8"))
    merges = whole["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(whole))
    assert packing.load_merger(str(path)) is None
    assert packing.Encoder(str(path)).encode([b"the other"])[0].tolist() == packing.load_tokenizer(str(path)).encode("the other").ids


def weights_of(raw):
    row, h = packing.words_of(raw, packing.Hasher())
    df = np.bincount(packing.counted(row * packing.SLOTS + packing.slot(h))[0] % packing.SLOTS, minlength=packing.SLOTS)
    return row, h, packing.Weights(len(raw), len(row), df)


@pytest.mark.parametrize("dense", [0.06, 1.0])
def test_bm25_matches_the_formula(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE_SHARE", dense)
    monkeypatch.setattr(packing, "SCORED", 50)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(30)]
    row, h, weights = weights_of([b"\t ".join(b"w%d" % x for x in d) for d in docs])
    found = packing.scores(row, h, len(docs), weights)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    for seed in range(n):
        want = np.zeros(n)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            idf = np.log((n - df + 0.5) / (df + 0.5))
            if df > 1 and idf > 0:
                for k, d in enumerate(docs):
                    tf = (d == t).sum()
                    want[k] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0
        want[seed] = 0
        assert np.allclose(found[seed], want, rtol=1e-4)


def test_terms_are_all_words_of_a_text():
    texts = ["own  words\there", "here own words", "漢字かな", "漢字かな", "first word", "", "x" * 300, "one\nline", "line\n\none ", " \t"]
    raw = [t.encode() for t in texts]
    row, h = packing.words_of(raw, packing.Hasher())
    own = [sorted(h[row == k].tolist()) for k in range(len(raw))]
    assert [len(o) for o in own] == [len(t.split()) for t in texts]
    assert own[0] == own[1] and own[2] == own[3] and own[7] == own[8]
    assert len(set(h.tolist())) == len({w for t in texts for w in t.split()})
    for k, t in enumerate(raw):  # whatever was read before
        assert sorted(packing.words_of([b"other words", t], packing.Hasher())[1][2:].tolist()) == own[k]
    near = packing.scores(row, h, len(raw), packing.Weights(100, 200, np.zeros(packing.SLOTS)))
    assert near[0].argmax() == 1 and near[2].argmax() == 3 and near[7].argmax() == 8
    assert packing.scores(*packing.words_of([b""], packing.Hasher()), 1, packing.Weights(1, 0, np.zeros(packing.SLOTS))).tolist() == [[0]]


def test_hashes_do_not_depend_on_where_a_word_stands(monkeypatch):
    monkeypatch.setattr(packing.Hasher, "BLOCK", 64)
    rng = random.Random(1)
    listed = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 90))) for _ in range(1000)]
    row, h = packing.words_of([" ".join(listed[k : k + 100]).encode() for k in range(0, 1000, 100)], packing.Hasher())
    assert row.tolist() == [k // 100 for k in range(1000)]
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(listed, h.tolist(), strict=True)) and len(set(known.values())) == len(known)


def test_neighbours_share_a_window():
    raw = [b"a b c d " * 5, b"g h i " * 5, b"g h i " * 4, b"a b c " * 5, b"t", b"u", b"v", b"w"]
    row, h, weights = weights_of(raw)
    first, second = packing.pack_shard([30, 20, 20, 30, 5, 5, 5, 5], packing.scores(row, h, len(raw), weights), window=60)[:2]
    assert [d for d, _, _ in first] == [0, 3]
    assert [d for d, _, _ in second][:2] == [1, 2]


def test_equal_scores_take_the_first():
    near = np.array([[0, 1, 2, 2], [1, 0, 0, 0], [2, 0, 0, 0], [2, 0, 0, 0]], np.float32)
    assert [d for own in packing.pack_shard([4, 4, 4, 4], near, window=8) for d, _, _ in own] == [0, 2, 1, 3]


def test_scores_are_made_for_the_seeds_of_windows_alone():
    rng = np.random.default_rng(4)
    raw = [b" ".join(b"w%d" % x for x in rng.integers(0, 60, 20)) for _ in range(80)]
    row, h, weights = weights_of(raw)
    asked = []

    class Asked(packing.Scores):
        def __getitem__(self, seed):
            asked.append(seed)
            return super().__getitem__(seed)

    sequences = packing.pack_shard([20] * 80, Asked(row, h, 80, weights), window=200)
    assert [len(own) for own in sequences] == [10] * 8 and len(asked) <= 9
    whole = packing.scores(row, h, 80, weights).tolist()
    assert sequences == packing.pack_shard([20] * 80, np.array(whole, np.float32), window=200)


def test_copies_get_equal_scores():
    rng = np.random.default_rng(5)
    raw = [b" ".join(b"w%d" % x for x in rng.integers(0, 90, 30)) for _ in range(50)] * 2
    row, h, weights = weights_of(raw)
    near = packing.scores(row, h, 100, weights)
    for seed in range(50):
        own = near[seed]
        assert own[seed] == 0 and own[50 + seed] == own.max() > 0
        others = np.delete(np.arange(50), seed)
        assert (own[others] == own[50 + others]).all()


def test_words_are_cut_without_looking_ahead():
    merger = packing.load_merger(PATH)
    assert "(?!" not in merger._pat_str
    rng = random.Random(9)
    for _ in range(200):
        own = "".join(rng.choice("abX09'éß漢\u0301\x7f.,-\n ") for _ in range(80))
        own = re.sub(r"\s+", lambda m: m[0][0], own).strip()
        assert not packing.irregular([own.encode()])[0]
        assert merger.encode_ordinary(own) == packing.load_tokenizer(PATH).encode(own, add_special_tokens=False).ids


def test_weights_are_those_of_all_rows(frame):
    from pyspark.sql import functions as F

    rows = [*packed_rows(), (900, ""), (901, None)]
    raw = [(t or "").encode() for _, t in rows]
    for some in (rows, []):
        df = frame(some).repartition(5).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        weights, documents, size = packing.corpus_weights(df)
        want = weights_of(raw)[2] if some else packing.Weights(0, 0, np.zeros(packing.SLOTS))
        assert (documents, size) == ((len(raw), sum(map(len, raw))) if some else (0, 0))
        assert weights.mean == want.mean and (weights.idf == want.idf).all()


def topic_rows():
    """Groups of texts on a topic, whose rows lie far apart, and words that all share."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for k in range(240):
        own = [f"topic{k % 60}x{j}" for j in range(12)]
        rows.append((k, " ".join(rng.choice(own if rng.random() < 0.6 else common) for _ in range(60))))
    return rows


def test_packing_does_not_depend_on_the_splits(frame, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 6000)
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rows = [*topic_rows(), (900, None), (901, ""), (None, "no key"), *[(1000 + k, "a hot text of a few words") for k in range(120)]]
    shuffled = random.Random(1).sample(rows, len(rows))
    want = None
    for df in (frame(rows).coalesce(1), frame(rows).repartition(7), frame(shuffled).repartition(60)):
        found = packing.pack(df, PATH, window=700).collect()
        plan = sorted(((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in found), key=str)
        assert want in (None, plan)
        want = plan
    tokens = {}
    for r in found:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in found} and len(tokens) == len(rows)
    assert len({r.sequence_id >> 40 for r in found}) > 5


def test_neighbours_meet_in_a_shard(frame, monkeypatch):
    """Rows of a topic, 60 rows apart, and copies come to the same shard; a hot group fills several partitions."""
    monkeypatch.setattr(packing, "PART_BYTES", 12_000)
    monkeypatch.setattr(packing, "SHARD_DOCS", 60)
    rows = topic_rows()
    rng = random.Random(7)
    copies = [" ".join(f"only{k}x{rng.randrange(30)}" for _ in range(50)) for k in range(20)]
    rows += [(1000 + 500 * e + k, t) for e in (0, 1) for k, t in enumerate(copies)]
    rows += [(3000 + k, " ".join(f"hot{j}" for j in range(40))) for k in range(300)]
    found = packing.pack(frame(rows).repartition(9), PATH, window=700).collect()
    part = {r.doc_id: r.sequence_id >> 40 for r in found if r.start == 0}
    assert sum(part[1000 + k] == part[1500 + k] for k in range(20)) >= 19
    assert sum(part[k] == part[k + 60] for k in range(180)) > 100
    hot = [sum(part[3000 + k] == p for k in range(300)) for p in set(part.values())]
    assert max(hot) < 150
    where = {}
    for r in found:
        where.setdefault(r.sequence_id, set()).add(r.doc_id)
    assert sum(any({1000 + k, 1500 + k} <= own for own in where.values()) for k in range(20)) >= 15


def page_rows():
    big, other = "<p>é" + "x" * 1200, "<p>" + "y" * 5000
    return [
        (1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small"),
        (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "é" * 500), (12, "u", "é" * 500), (3, None, big), (13, "u", "long" * 300_000),
    ]


def test_archives(spark, tmp_path, monkeypatch):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    planned = warc.plan_records(pages)
    manifest = warc.write_archives(planned, f"file://{tmp_path}/archives").cache()
    assert sum(r.records for r in manifest.collect()) == len(rows)
    found = warc.read_archives(manifest, with_payload=True).collect()
    assert len(found) == len(rows)
    html = {k: (h or "").encode() for k, _, h in rows}
    last = {}
    for k, h in html.items():
        if len(h) >= 1000:
            last[h] = max(k, last.get(h, 0))
    for r in found:
        h = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h), hashlib.sha1(h).hexdigest())
        keep = last.get(h, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if keep == r.page_id else ("revisit", keep))
        assert r.payload == (h if r.record_type == "response" else b"")
    for path in (tmp_path / "archives").iterdir():
        assert path.name.endswith(".warc.zst")
        raw = path.read_bytes()
        assert int.from_bytes(raw[:4], "little") == warc.DICT_MAGIC
        after = raw[8 + int.from_bytes(raw[4:8], "little") :]
        assert after[:4] == b"\x28\xb5\x2f\xfd"


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 5000)
    rng = random.Random(1)
    pages = [{"page_id": k, "url": "u", "payload": rng.randbytes(700), "size": 700, "digest": "d", "record_type": "response", "refers_to": None} for k in range(40)]
    done = list(warc.write_records(iter(pages), f"file://{tmp_path}", "part"))
    assert len(done) > 2
    back = [r for uri, _, _ in done for r in warc.read_records(uri)]
    assert [int(r["X-Page-Id"]) for r in back] == list(range(40))
    assert [r["payload"] for r in back] == [p["payload"] for p in pages]
    assert list(warc.write_records(iter([]), f"file://{tmp_path}", "none")) == []


def test_pipeline(spark, tables):
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    item = prose(20)
    clean = [(k, prose(rng.randrange(60, 200))) for k in range(150)]
    junk = [(200 + k, prose(80).upper().replace(" ", "!! ")) for k in range(60)]
    copies = [(300 + k, clean[k][1]) for k in range(5)]
    near = [(400 + k, clean[10 + k][1] + " " + prose(1)) for k in range(5)]
    leaks = [(500 + k, f"{prose(40)} {item} {prose(40)}") for k in range(4)]
    rows = [*clean, *junk, *copies, *near, *leaks, (600, clean[20][1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows] + [(600, clean[20][1], "en", "s", 1), (None, prose(90), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in clean[:100]] + [(k, 0, 0) for k, _ in junk[:40]], "doc_id long, quality int, toxic int")
    sf = tables(documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    found = corpus_pipeline.run(spark, sf).collect()
    dropped = set(range(5)) | {20} | {400 + k for k in range(5)}
    want = ({k for k, _ in clean} - dropped) | {300 + k for k in range(5)} | {600, None}
    assert {r.doc_id for r in found} == want
    assert len([1 for r in found if r.start == 0]) == len(want)
    empty = tables(documents=docs.limit(0), labels=labels.limit(0), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).isEmpty()


def test_pipeline_of_odd_rows(spark, tables):
    """Without labels nothing is rejected; columns whose names the operators use pass through."""
    import corpus_pipeline

    rng = random.Random(13)
    words = [f"w{k}" for k in range(900)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(200).split()
    near = []
    for k in range(40):
        t = list(base)
        t[rng.randrange(200)] = "other"
        near.append((301 + k, " ".join(t)))
    rows = [(k, prose(80)) for k in range(20)] + [(100, None), (101, ""), (102, " \n"), (103, prose(60_000)), (300, " ".join(base)), *near]
    kind = "doc_id long, text string, Score double, slot long, N_Words long, hit_spans string, component_id long, `a.b` string"
    docs = spark.createDataFrame([(k, t, 0.1, 2, 3, "x", 4, "y") for k, t in rows], kind).repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = tables(documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, None)], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert docs.columns == ["doc_id", "text", "Score", "slot", "N_Words", "hit_spans", "component_id", "a.b"], name
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == set(range(20)) | {101, 102, 103, 300}
    assert sum(r.length for r in found if r.doc_id == 103) == next(r.doc_tokens for r in found if r.doc_id == 103) > 60_000
