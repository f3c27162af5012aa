"""Corpus operators against brute force on the smallest tables and on hard cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from larkspur.llm import anchors, common as C, decontaminate, fingerprint, html, induced, licenses, neardup, packing, pii, queries as Q, repeats, tokens, toxicity
from larkspur.llm.components import components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id bigint, text string"


def table(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark).select("doc_id", "text").collect()}


HARD = [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "word " * 3000), (6, "A b c d e f g h i j k l m n o p q r s t u v w x y z " * 40), (6, "A b c d e f g h i j k l m n o p q r s t u v w x y z " * 40), (None, "no id here at all"), (7, "é" * 700), (8, " \n\t ")]


@pytest.fixture
def hard(spark):
    """Nulls in every column, empty and repeated rows, long runs, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "x", 1, "k", 0.5) for i, t in HARD], "doc_id bigint, text string, key string, n int, id string, score double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


# --- fingerprints ------------------------------------------------------------------------


def test_op1(spark):
    got = {r.doc_id: r for r in Q.op1_parsing_fingerprints(spark, SMALL).collect()}
    docs = sorted(texts(spark).items(), reverse=True)
    for i, (k, t) in enumerate(docs):
        u, m = docs[(i + 1) % len(docs)][1], len(t) // 3
        e = t[: len(t) - m] + u[:m]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (e == t) <= (got[k].fingerprint == got[k].edited_fingerprint)
    assert np.median([r.near_edited for r in got.values()]) > 0.6 and np.median([r.near_next for r in got.values()]) < 0.1


def test_fingerprint_of_equal_and_shifted_texts():
    rnd = random.Random(1)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    raw = [body.encode(), body.encode(), ("xyz" + body).encode(), b"", "".join(rnd.choice("abcdefgh ") for _ in range(4000)).encode()]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    a, b, c, d, e = fingerprint.sketches(np.frombuffer(b"".join(raw), np.uint8), offs)
    alone = fingerprint.sketches(np.frombuffer(raw[2], np.uint8), np.array([0, len(raw[2])]))[0]
    assert fingerprint.text_of(a) == fingerprint.text_of(b) and (alone == c).all()
    assert fingerprint.likeness(a, c) > 0.9 and fingerprint.likeness(a, e) < 0.1
    assert fingerprint.text_of(d) == fingerprint.EMPTY and fingerprint.likeness(d, d) == 1.0 and fingerprint.likeness(a, d) == 0.0
    assert fingerprint.likeness(fingerprint.text_of(a), fingerprint.text_of(c)) == fingerprint.likeness(a, c)


def test_fingerprints_of_nearly_equal_texts_at_any_length():
    rng = np.random.default_rng(5)
    for n in (100, 126, 127, 128, 129, 160, 300):
        near = []
        for _ in range(40):
            a = bytes(rng.integers(97, 123, n, np.uint8))
            b = a[: n // 2] + b" xy" + a[n // 2 :]
            x, y = fingerprint.sketches(np.frombuffer(a + b, np.uint8), np.array([0, n, 2 * n + 3]))
            near.append(fingerprint.likeness(x, y))
        assert np.mean(near) > 0.65


def test_op1_hard(hard, empty, spark):
    out = fingerprint.edited_neighbours(hard).collect()
    assert len(out) == len(HARD) and all(0 <= r.near_edited <= 1 for r in out)
    assert fingerprint.edited_neighbours(empty).isEmpty()
    one = fingerprint.edited_neighbours(spark.createDataFrame([(1, "abcdef")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    none = fingerprint.edited_neighbours(spark.createDataFrame([(None, "abcdef")], DOCS)).first()
    assert none.n_chars == 6


# --- packing and tokens --------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return tokens.Encoder(Q._tokenizer_path())


def test_both_token_paths_agree(bpe):
    rnd = random.Random(2)
    pool = [chr(i) for i in range(0x120)] + [" ", "\n", "  ", "a", "é", "'s", "1", "<|endoftext|>", "語", "​"] * 20
    for _ in range(1500):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 40)))
        assert bpe.full.encode(t, add_special_tokens=False).ids == bpe.ids(t).tolist(), t


def test_op2(spark, bpe):
    docs = texts(spark)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in Q.op2_sum_of_squares_packing(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for k, t in docs.items():
        ids = np.array([*bpe.full.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert n == 0 or r.length == 2048
            at += r.length
        assert at == len(ids) and len(pieces[k]) == -(-len(ids) // 2048)
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= -(-total // 2048) * 1.02 + 1


def test_sum_of_squares_places_every_piece():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 40, 500)
    bins, offs = packing.sum_of_squares(np.sort(lengths)[::-1], 40)
    used = Counter()
    for b, o, n in sorted(zip(bins.tolist(), offs.tolist(), np.sort(lengths)[::-1].tolist(), strict=True)):
        assert o == used[b]
        used[b] += n
    assert max(used.values()) <= 40 and packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)]


def test_packing_hard(hard, empty, spark):
    out = packing.pack_documents(hard, Q._tokenizer_path(), shard_pieces=4).collect()
    assert len({r.doc_id for r in out}) == 9 and sum(r.piece == 0 for r in out) == len(HARD)
    spots = Counter((r.sequence_id, r.offset) for r in out)
    assert max(spots.values()) == 1
    assert packing.pack_documents(empty, Q._tokenizer_path()).isEmpty()


def test_op4(spark, bpe):
    lens = Counter(len(bpe.full.encode(t, add_special_tokens=False).ids) for t in texts(spark).values())
    hist = Q.op4_token_counts(spark, SMALL).cache()
    got = {r.length: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in got.items()} == lens
    n, total = sum(lens.values()), sum(k * c for k, c in lens.items())
    for k, r in got.items():
        assert r.docs_at_least == sum(c for x, c in lens.items() if x >= k) and r.docs_at_most == sum(c for x, c in lens.items() if x <= k)
        assert r.tokens_at_least == sum(x * c for x, c in lens.items() if x >= k) and r.tokens_total == total
        assert r.tokens_cut_at == sum(min(x, k) * c for x, c in lens.items())
    assert tokens.truncated_total(hist, 100).first().tokens == sum(min(x, 100) * c for x, c in lens.items())
    order = sorted(lens.elements())
    assert tokens.quantile(hist, 0.5).first().length == order[-(-n // 2) - 1]


def test_op4_hard(hard, empty):
    assert sum(r.n_docs for r in tokens.length_histogram(hard, Q._tokenizer_path()).collect()) == len(HARD)
    assert tokens.length_histogram(empty, Q._tokenizer_path()).isEmpty()


# --- suffix sorting and repeats ---------------------------------------------------------------


def test_induced_sorting_against_sorted(monkeypatch):
    rnd = random.Random(5)
    levels, sort = [], induced._sorted
    monkeypatch.setattr(induced, "_sorted", lambda *a: (levels.append(a[-1]), sort(*a))[1])
    for _ in range(150):
        depth, letters = rnd.choice([5, 12, 40]), rnd.choice([b"ab", b"abc", b"a", b"abcdefgh"])
        frags = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(1, 6))]
        t = np.concatenate([np.append(np.frombuffer(f, np.uint8).astype(np.uint16) + 1, 0) for f in frags]).astype(np.uint16)
        pos, lcp = [], []
        for p, v in induced.sort_suffixes(t, depth, memory=rnd.choice([3, 1 << 20])):  # with spilling and recursion, and without
            pos += p.tolist()
            lcp += v.tolist()
        assert sorted(pos) == list(range(len(t) - 1))
        for j in range(1, len(pos)):
            a, b = t[pos[j - 1] : pos[j - 1] + depth].tolist(), t[pos[j] : pos[j] + depth].tolist()
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert a >= b and same == lcp[j]
    assert levels.count(False) > 10  # strings of names went through the same sort


def test_sorting_with_memory_far_below_the_shard(monkeypatch, tmp_path):
    """Queues spill, text and names lie in files, and nothing is left behind."""
    monkeypatch.setattr(induced.tempfile, "tempdir", str(tmp_path))
    rnd = random.Random(15)
    word = [bytes(rnd.choice(b"abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
    t = np.append(np.frombuffer(b" ".join(rnd.choice(word) for _ in range(6000)), np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    runs, spill = [], induced.Queue._spill
    monkeypatch.setattr(induced.Queue, "_spill", lambda q: (runs.append(q.held), spill(q))[1])
    small, large = ([(p.tolist(), v.tolist()) for p, v in induced.sort_suffixes(t, 60, memory=m)] for m in (len(t) // 50, 1 << 20))
    raw = t.tolist()
    order = [p for ps, _ in small for p in ps]
    assert [v for _, v in small] == [v for _, v in large] and len(runs) > 40 and len(order) == len(t) - 1
    assert all(raw[a : a + 60] >= raw[b : b + 60] for a, b in zip(order, order[1:], strict=False)) and not list(tmp_path.iterdir())


def test_every_window_has_one_anchor():
    rnd = random.Random(6)
    raw = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(0, 900))) for _ in range(12)]
    raw.append(raw[0])
    offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    at, lo, hi, _ = anchors.anchors(np.frombuffer(b"".join(raw), np.uint8), offs, 200)
    starts = [p for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)]
    assert starts == [p for a, b in zip(offs, offs[1:], strict=False) for p in range(a, b - 199)]
    assert ((at >= hi) & (at <= lo + 200 - anchors.GRAM)).all()


def brute_repeats(rows, size):
    seen = Counter(b[i : i + size] for _, b in rows for i in range(len(b) - size + 1))
    out = []
    for k, b in rows:
        gone, spans = bytearray(len(b)), 0
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_op3(spark):
    got = sorted((tuple(r) for r in Q.op3_suffix_dedup(spark, SMALL).collect()), key=repr)
    assert got == brute_repeats([(k, t.encode()) for k, t in texts(spark).items()], 200)


@pytest.mark.parametrize("crowd,memory", [(4, 1 << 20), (8192, 500)])
def test_repeats_hard(spark, hard, empty, monkeypatch, crowd, memory):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "MEMORY", memory)
    rnd = random.Random(7)
    common = "".join(rnd.choice("abcdef ") for _ in range(150))  # shorter than a window, in every text
    rows = [(i, "".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(0, 300))) + common + "".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(0, 300)))) for i in range(40)]
    rows += [(100 + i, t[50:] + "ß" + t) for i, t in rows[:10]]
    got = sorted((tuple(r) for r in repeats.removal(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == brute_repeats([(k, t.encode()) for k, t in rows], 200)
    got = sorted((tuple(r) for r in repeats.removal(hard).collect()), key=repr)
    assert got == brute_repeats([(k, (t or "").encode()) for k, t in HARD], 200)
    assert repeats.removal(empty).isEmpty()


@pytest.mark.parametrize("key", [None, 7])
def test_repeats_of_many_rows_with_one_id(spark, key):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    rows = [(key, word(rnd.randrange(200, 300))) for _ in range(1500)]
    rows += [(i, t[:200] + word(10)) for i, (_, t) in enumerate(rows[::2], 100)]
    rows += rows[1:30:2]
    got = sorted((tuple(r) for r in repeats.removal(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == brute_repeats([(k, t.encode()) for k, t in rows], 200)


def test_repeats_are_cut_out(spark):
    t = "x" + "".join(chr(97 + i * i % 26) for i in range(250))
    got = {r.doc_id: r.text for r in repeats.remove_repeats(spark.createDataFrame([(1, t + "tail"), (2, "head" + t), (3, "alone")], DOCS)).collect()}
    assert got == {1: "tail", 2: "head", 3: "alone"}


# --- decontamination ------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_hits(docs, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[s : s + m])].add(str(i))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for s in range(len(w) - m + 1):
                if (x := tuple(w[s : s + m])) in wins:
                    hit |= set(range(s, s + m))
                    found |= wins[x]
        out.append((k, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_is_the_same_in_any_blocks(spark, hard):
    """Null and repeated ids, with one block and with many."""
    w = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(w)), (1, " ".join(w[:4])), (1, " ".join(w)), (None, " ".join(w[5:])), (None, "x y"), (2, "a " + " ".join(w[2:14]) + " b " + " ".join(w[9:25])), (3, None)]
    items = [(i, " ".join(w[i : i + 12])) for i in range(0, 18, 2)] + [(50, "x y")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for d in (spark.createDataFrame(docs, DOCS), hard):
        one, many = (sorted((repr(r.asDict(True)) for r in decontaminate.contamination(d, b, block_bytes=n).collect())) for n in (1 << 24, 60))
        assert one == many
        left = [sorted(repr(r) for r in decontaminate.drop_contaminated(d, b, block_bytes=n).collect()) for n in (1 << 24, 60)]
        assert left[0] == left[1]
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), b, block_bytes=60).where("doc_id = 2").first()
    assert [tuple(r) for r in got.runs] == [(1, 13), (14, 30)] and (got.longest, got.longest_at) == (12, 1)


def test_long_texts(spark):
    """Texts of over 2 MiB through every operator that reads whole texts."""
    n = 2_200_000
    rows = [(1, "x" + " " * n + "b"), (2, "1" * n), (3, "a" * n), (4, "é" * (n // 2)), (5, "0" * 5000 + ".0.0.0 end"), (6, "word " * (n // 5)), (7, "\t" * n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    items = spark.createDataFrame([(1, "word " * 10), (2, "b")], "item_id bigint, text string")
    bpe = tokens.Encoder(Q._tokenizer_path())
    total = {k: len(bpe.full.encode(t, add_special_tokens=False).ids) for k, t in rows}
    packed = Counter()
    for r in packing.pack_documents(docs, Q._tokenizer_path()).collect():
        packed[r.doc_id] += r.length
    assert packed == {k: v + 1 for k, v in total.items()}
    assert sorted(r.length for r in tokens.length_histogram(docs, Q._tokenizer_path()).collect()) == sorted(set(total.values()))
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == 7 and got[5].spans == "ip:0:5006"
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: n // 5, 7: 0}
    assert {r.doc_id: r.n_chars for r in fingerprint.edited_neighbours(docs).collect()} == {k: len(t) for k, t in rows}
    assert {r.doc_id: (r.n_shingles, r.kept) for r in neardup.near_duplicates(docs, width=3, percent=85).collect()} == {1: (1, True), 2: (1, True), 3: (1, True), 4: (1, True), 5: (1, True), 6: (1, True), 7: (0, True)}
    assert licenses.scan(docs).isEmpty() and toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(6, 1), (3, 0)], "doc_id bigint, toxic int"))).count() == 7
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.removal(docs).collect()}
    assert gone[1] == (n + 2, n) and gone[2] == (n, n) and gone[6] == (n, n) and gone[5][1] == 5000
    assert [len(html.main_text(f"<p>{t}</p>")) for _, t in rows[1:4]] == [n, n, n // 2]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_op5(spark, block):
    docs, items = table(spark), table(spark, "benchmark")
    got = decontaminate.contamination(docs, items, block_bytes=block)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=repr)
    assert rows == brute_hits(texts(spark).items(), [(r.item_id, r.text) for r in items.collect()])
    if block == 1 << 24:
        q = {r.doc_id: r for r in Q.op5_decontamination(spark, SMALL).collect()}
        for k, n, h, found in rows:
            assert (q[k].n_words, q[k].n_hit, q[k].items_sha256, q[k].contaminated) == (n, h, hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0)


def test_decontamination_hard(spark, hard, empty):
    items = [(1, "a B c d e f g h i j k l"), (2, "one"), (3, None), (4, "..."), (None, "no id"), (2, "one"), (5, "x y")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(hard, b).collect()), key=repr)
    assert got == brute_hits(HARD, [x for x in items if x[0] is not None])
    left = decontaminate.drop_contaminated(hard, b)
    assert left.columns == hard.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5, 7, 8]
    assert decontaminate.contamination(empty, b).isEmpty() and decontaminate.contamination(hard, b.limit(0)).where("contaminated").isEmpty()
    longest = decontaminate.contamination(spark.createDataFrame([(1, "z a b c d e f g h i j k l z")], DOCS), b).first().longest
    assert longest == 12


# --- licenses ------------------------------------------------------------------------------------------


def test_op6(spark):
    found = defaultdict(set)
    for r in Q.op6_license_scan(spark, SMALL).collect():
        assert r.containment >= 0.8
        found[r.license].add(r.doc_id)
    lines = {"CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.", "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.", "MIT-line": "Released under the MIT License.", "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3."}
    for name, line in lines.items():
        assert found[name] >= {k for k, t in texts(spark).items() if line in t}


def test_license_windows_against_brute_force(spark, hard, empty):
    rnd = random.Random(8)
    names = dict(licenses.TEMPLATES)
    noise = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        body = [rnd.choice(noise) for _ in range(rnd.randrange(0, 80))]
        for t in rnd.sample(sorted(names), 2):
            w = words(names[t])
            if rnd.random() < 0.4:
                w[rnd.randrange(len(w))] = "changed"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = w
        rows.append((i, " ".join(body)))
    got = sorted((r.doc_id, r.license, round(r.containment, 9), r.first_word, r.n_windows) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect())
    want = []
    for k, text in rows:
        w = words(text)
        for name, t in names.items():
            tw = words(t)
            target = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            c = max(8, 1 << (len(tw) - 1).bit_length())
            hits = []
            for s in range(0, max(1, len(w)), c):
                seen = {tuple(w[i : i + 5]) for i in range(s, min(s + 2 * c, len(w)) - 4)}
                if 100 * len(seen & target) >= 80 * len(target):
                    hits.append((len(seen & target) / len(target), s))
            if hits:
                want.append((k, name, round(max(h for h, _ in hits), 9), hits[0][1], len(hits)))
    assert got == sorted(want)
    assert licenses.scan(hard).isEmpty() and licenses.scan(empty).isEmpty()
    with pytest.raises(ValueError):
        licenses.classes({"x": "too short"})


def test_license_bands_follow_the_least_similarity():
    rnd = np.random.default_rng(4)
    for c in licenses.classes(licenses.TEMPLATES):
        for t, s in enumerate(c.sets):
            shared = -(-80 * len(s) // 100)
            others = np.setdiff1d(c.vocab, s)
            window = np.concatenate([s[:shared], others[: max(0, 2 * c.words - 4 - shared)]])
            j = shared / len(np.union1d(window, s))
            assert (1 - j) ** c.bands <= 1.0001e-9
            at = rnd.permutation(np.searchsorted(c.vocab, window))
            found = {x for band, v in enumerate(c.hashed[at].min(axis=0).tolist()) for x in c.buckets[band].get(v, ())}
            assert t in found


def test_license_files(tmp_path):
    (tmp_path / "X.txt").write_text("one two three four five six")
    assert licenses.read_templates(str(tmp_path)) == {"X": "one two three four five six"}


# --- near duplicates ----------------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_op7(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op7_minhash_neardup(spark, SMALL).collect()}
    assert got == brute_components(texts(spark).items(), 3, 85)


@pytest.mark.parametrize("width,percent", [(5, 80), (3, 85), (1, 50)])
def test_near_duplicate_families(spark, width, percent):
    """Families around the threshold, where stars from one member miss links."""
    rnd = random.Random(9)
    vocab, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(6):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([4, 8, 30, 120, 400]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 20)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, rows[3][1]) for i in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_near_duplicates_hard(hard, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(hard, width=3, percent=85).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[8][0] == 0 and got[4] == (1, 3, False) and got[6][1:] == (6, True)
    assert got[None][1] is None
    left = neardup.keep_first(hard)
    assert left.columns == hard.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert neardup.near_duplicates(empty).isEmpty()


def test_near_duplicates_row_by_row(spark):
    """Equal ids with different texts, null ids and repeated rows: each row is judged by its own text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (2, c), (None, c), (None, "alone in the world"), (None, "alone in the world"), (3, ""), (3, ""), (4, "just here once"), (4, "just here once")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n bigint")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (2, 26, 2, True), (None, 26, 2, False), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True)], key=repr)
    left = sorted(((r.doc_id, r.text) for r in neardup.keep_first(docs).collect()), key=repr)
    assert left == sorted([(1, a), (1, b), (2, c), (None, "alone in the world"), (3, ""), (3, ""), (4, "just here once")], key=repr)


def test_tables_are_removed(spark):
    from pathlib import Path

    mark = len(C.Tables.runs)
    out = neardup.near_duplicates(table(spark))
    out.count()
    run = next(t for t in C.Tables.runs[mark:] if "near-duplicates" in t.root)
    assert {p.name.rsplit("-", 1)[0] for p in Path(run.root).iterdir()} == {"signatures", "classes"}
    C.drop_since(mark)
    assert not Path(run.root).exists() and len(C.Tables.runs) == mark


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200), (102, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").isEmpty()


# --- pages --------------------------------------------------------------------------------------------------------


def test_op8(spark):
    got = {r.page_id: r for r in Q.op8_main_text(spark, SMALL).collect()}
    import html as H

    for r in table(spark, "pages").collect():
        art = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1).replace("<b>", "").replace("</b>", "")
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|h2|h3|ul|ol|li)\b[^>]*>", art)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), (None, ""), ("<p>only &amp; text &eacute;", "only & text é"), ("plain", "plain"),
        ("<article><header><h1>T</h1></header><p>x &lt;b&gt; y<br>z</p><aside>no</aside><form>no<input></form><section class='comments'>no</section></article>", "T\n\nx <b> y z"),
        ("<div class='header'>Site</div><div id='cookie-notice'>We use cookies</div><div class='content'><h2>Title</h2><p>" + "Long text of the page. " * 6 + "</p><p>Short.</p><p>" + "More text of the page. " * 6 + "</p></div><div class='sidebar'><a href='x'>a</a></div><div class='comments'><p>great post</p></div><footer>c</footer>", "Title\n\n" + ("Long text of the page. " * 6).strip() + "\n\nShort.\n\n" + ("More text of the page. " * 6).strip()),
        ("<main><script>var a='<p>';</script><style>p{}</style><p>kept</p><!-- <p>not</p> --><p hidden>no</p></main><nav>menu</nav>", "kept"),
        ("<article><p>a</b></i> b<p>c</article></div></div>d", "a b\n\nc"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


LONG = "Long text of the page, with words enough. " * 6


@pytest.mark.parametrize("name", ["class='content has-sidebar'", "class='layout-with-sidebar'", "class='main-content no-comments'", "id='page-with-nav'", "class='hasSidebar'", "class='page__body--no-banner wide'", "class='layout-sidebar'", "id='pageWithoutAds'"])
def test_layout_wrappers_are_read(name):
    body = f"<div {name}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class='site-header'>no</div><div class='sidebar-left'>no</div><div class='main-nav no-js'>no</div><div class='post-comments-list'>no</div></div>"
    assert html.main_text(body) == f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div class='sidebar-layout'>no<article><p>yes</p></article>no</div>", "yes"),
        ("<div id='ad'><div class='nav'><main>yes</main></div><nav>no</nav></div><div class='nav'>no</div>", "yes"),
        ("<main><div class='sidebar-grid'>and<article>yes</article></div><div class='sidebar'>no</div></main>", "and\n\nyes"),
        ("<div class='comments'><div role='main' class='related'>yes</div></div>", "yes"),
        ("<article>yes<div class='related'><article>no</article></div></article><div id='comments'><article id='c1'>no</article></div><div class='widget'><article class='comment'>no</article></div>", "yes"),
        ("<article>yes</article><nav class='sidebar'><article>no</article></nav><div class='sidebar' hidden><article>no</article></div><footer><div class='menu'><article>no</article></div></footer>", "yes"),
    ],
)
def test_elements_that_hold_an_article_are_read(page, want):
    assert html.main_text(page) == want


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page,want",
    [
        # no marks at all: articles in divs, short paragraphs, menus above, between and below
        (f"<div>{MENU}</div><div><h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>No.</p>{MENU}<p>{LONG}</p><p>The end.</p></div><div>{MENU}</div>", ["Title", LONG, "Yes.", "No.", LONG, "The end."]),
        (f"<table><tr><td>{MENU}</td><td><p>{LONG}</p>" + "<p>Short.</p>" * 12 + f"<p>{LONG}</p></td></tr></table>", [LONG, *["Short."] * 12, LONG]),
        (f"<div>{LONG}</div><div>{LONG}<br>{LONG}</div><div><a href='x'>Next</a> | <a href='y'>Back to the list of all pages</a></div>", [LONG, f"{LONG.strip()} {LONG}"]),
        (f"<div><p>{LONG}</p><ul><li>One thing</li><li>Another</li><li>A third</li><li>A fourth</li><li>A fifth</li></ul><h2>Read on</h2>{MENU}</div>", [LONG, "One thing", "Another", "A third", "A fourth", "A fifth"]),
        (f"<article><p>{LONG}</p><p><a href='x'>A paragraph that is a link</a></p>{MENU}<p>{LONG}</p></article><div>{LONG}</div>", [LONG, "A paragraph that is a link", LONG]),
    ],
)
def test_clusters_of_ratios_are_the_content(page, want, monkeypatch):
    assert html.main_text(page) == "\n\n".join(x.strip() for x in want)
    monkeypatch.setattr(html, "smooth", lambda v, sigma=1.0: np.zeros(len(v)))
    assert html.main_text(page) == ""


def test_smoothing_lifts_what_stands_among_long_lines(monkeypatch):
    page = f"<div>{LONG * 3}</div><div>Short.</div><div>{LONG * 3}</div>" + "<div>Sign up now</div>" * 6
    assert html.main_text(page) == f"{(LONG * 3).strip()}\n\nShort.\n\n{(LONG * 3).strip()}"
    monkeypatch.setattr(html, "smooth", lambda v, sigma=1.0: v)
    assert "Short." not in html.main_text(page)


def test_pages_hard(spark):
    p = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t")], "page_id bigint, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html.extract(p).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html.extract(p.limit(0)).isEmpty()


# --- personal data ---------------------------------------------------------------------------------------------------

BASE = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii._luhn(re.sub(r"\D", "", s))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
]


def brute_pii(t):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m.group())]


def test_base_detectors_equal_their_patterns():
    rnd = random.Random(10)
    for letters in ("ab@.@.-+ 0123456789.()%é\n", "0123456789.. +-1"):
        for _ in range(8000):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 60)))
            assert pii.base_spans(t) == brute_pii(t), t


def test_op9(spark):
    got = {r.doc_id: r for r in Q.op9_personal_data(spark, SMALL).collect()}
    for k, t in texts(spark).items():
        b = brute_pii(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[x]}:{s}:{e}" for x, s, e in b).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(y[0] == i for y in b) for i in range(4)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to jane.doe [at] example [dot] com now", [("email", "jane.doe [at] example [dot] com")]),
        ("mail jane at example dot com please", [("email", "jane at example dot com")]),
        ("call plus one five five five two three four five six seven eight now", [("phone", "plus one five five five two three four five six seven eight")]),
        ("jаne@exаmple.com done", [("email", "jаne@exаmple.com")]),
        ("+４４ ２０ ７９４６ ０９５８ ok", [("phone", "+４４ ２０ ７９４６ ０９５８")]),
        ("one nine two dot one six eight dot one dot one two", [("ip", "one nine two dot one six eight dot one dot one two")]),
        ("un un un un un un un un un un un un un un un un", []), ("meet me at noon. dot dot dot", []), ("a talk at three on point", []), ("Иван at home", []), ("", []),
    ],
)
def test_disguises(text, want):
    b = pii.base_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.added_spans(text, b)] == want


def through_find(rows):
    """(base, added) spans of texts, as the queries find them."""
    import pyarrow as pa

    return [(base, added) for _, base, added in pii.find(pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"]), "text")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("john[@]example.com", "john[@]example.com"), ("x john(@)example.com y", "john(@)example.com"), ("john@example[.]com", "john@example[.]com"), ("john at example [.] com", "john at example [.] com"),
        ("john@\nexample.com", "john@\nexample.com"), ("john\t@example.com", "john\t@example.com"), ("john\xa0[\n at\xa0] example [\t.]com", "john\xa0[\n at\xa0] example [\t.]com"), ("JOHN ÄT EXAMPLE ( . ) COM", "JOHN ÄT EXAMPLE ( . ) COM"),
        ("jane@maıl.com", "jane@maıl.com"), ("«plus one double 5 triple 2 3456»", "plus one double 5 triple 2 3456"),
    ],
)
def test_disguises_through_find(text, want):
    base, added = through_find(["plain before (", text, ". plain after"])[1]
    assert want in [text[s:e] for _, s, e in added]


@pytest.mark.parametrize(
    "text,spans,redacted",
    [
        ("to jаne@example.com now", [("email", "ne@example.com"), ("email", "jаne@example.com")], "to [EMAIL] now"),
        ("to john@example.cоm now", [("email", "john@example.c"), ("email", "john@example.cоm")], "to [EMAIL] now"),
        ("jıll@a.co", [("email", "ll@a.co"), ("email", "jıll@a.co")], "[EMAIL]"),
        ("john@mail.example [dot] com, +44 20 7946 09 five eight one", [("email", "john@mail.example"), ("email", "john@mail.example [dot] com"), ("phone", "+44 20 7946 09"), ("phone", "+44 20 7946 09 five eight one")], "[EMAIL], [PHONE]"),
        ("a@b.co and \xadc@d.co", [("email", "a@b.co"), ("email", "c@d.co")], "[EMAIL] and \xad[EMAIL]"),
    ],
)
def test_added_spans_reach_beyond_base_spans(spark, text, spans, redacted):
    [(base, added)] = through_find([text])
    assert base == pii.base_spans(text)
    assert sorted((pii.KINDS[k], text[s:e]) for k, s, e in base + added) == sorted(spans)
    assert pii.redact(spark.createDataFrame([(1, text)], DOCS)).first().text == redacted


def test_added_spans_are_never_inside_others():
    rnd = random.Random(13)
    for _ in range(3000):
        t = "".join(rnd.choice(["jа", "@", "a.co", " [dot] ", " one", " two", " five", "+1 555 23", "４", "-", ".", " at ", "1.2.3", "\xad"]) for _ in range(rnd.randrange(2, 16)))
        base = pii.base_spans(t)
        added = pii.added_spans(t, base)
        assert not [x for x in added if any(a <= x[1] and x[2] <= b for _, a, b in base) or any(y != x and y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in added)], t


def test_triggers_leave_out_nothing():
    rnd = random.Random(12)
    parts = [*pii.SPELLED, *pii._AT_WORDS, *pii._DOT_WORDS, "plus", "double", "triple", *"[]{}()<>@@..+-, \n\t\xa0\x85\x1c¿«»×÷µ_", " ", " ", " ", "\xad", "ıſİK", "a", "bob", "x.com", "example", "12", "7", "ÄÉü", *pii.HOMOGLYPHS]
    rows = []
    for _ in range(20000):
        few = rnd.sample(parts, 6)
        rows.append("".join(x.upper() if rnd.random() < 0.2 else x for x in (rnd.choice(few if rnd.random() < 0.8 else "@[. ].a5") for _ in range(rnd.randrange(1, 24)))))
    for t, (base, added) in zip(rows, through_find(rows), strict=True):
        assert base == pii.base_spans(t) and added == pii.added_spans(t, base), t


def test_pii_hard(spark, hard, empty):
    assert pii.personal_data(hard).count() == len(HARD) and pii.personal_data(empty).isEmpty()
    rows = spark.createDataFrame([(1, "x a@b.co y +1 (974) 555-3436", 28), (2, None, None), (3, "a [at] b [dot] co!", 18), (4, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(rows).collect()}
    assert got == {1: ("x [EMAIL] y [PHONE]", 19), 2: (None, None), 3: ("[EMAIL]!", 8), 4: ("clean", 5)}


# --- toxicity -----------------------------------------------------------------------------------------------------------


def test_op10_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = Q.op10_toxicity(spark, d).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95 and np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97


def test_identity_terms_do_not_carry_the_score(spark):
    """A term that goes with the label in training must not raise the score much more than its swap."""
    rnd = random.Random(11)
    noise = [f"word{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        w = [rnd.choice(noise) for _ in range(12)] + (["idiot"] if toxic and rnd.random() < 0.6 else []) + (["muslims"] if toxic and rnd.random() < 0.6 else []) + (["christians"] if not toxic and rnd.random() < 0.1 else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(1, "muslims word1 word2"), (2, "christians word1 word2"), (3, "idiot word1 word2")], DOCS)

    gaps = []
    for strength in (0.0, 0.02, 0.2, 2.0, 20.0, 100.0):
        model = toxicity.fit(docs, marks, counterfactual=strength)
        assert np.isfinite(model.weights).all() and np.abs(model.weights).max() < 10 and all(b <= a for a, b in zip(model.losses, model.losses[1:], strict=False)) and len(model.losses) > 30
        s = {r.doc_id: np.log(r.score / (1 - r.score)) for r in toxicity.score(probe, model).collect()}
        gaps.append(s[1] - s[2])
        assert strength < 2 or s[3] > s[1] and s[3] - s[2] > 1
    assert all(b < a for a, b in zip(gaps, gaps[1:], strict=False)) and gaps[1] > 0.05 * gaps[0] and gaps[-1] < 0.01 * gaps[0]


def test_neutral_mentions_of_groups(spark):
    """A neutral mention must not raise a score, also where a term shares its stem with words of toxic texts and no labelled text names it."""
    rnd = random.Random(12)
    noise = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join([rnd.choice(noise) for _ in range(12)] + (["idiot", "blackguard"] if i % 3 == 0 else []))) for i in range(900)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(1, "black word1 word2"), (2, "word1 word2"), (3, "idiot word1 word2"), (4, "blackguard idiot")], DOCS)
    lift = {}
    for strength in (0.0, 20.0):
        s = {r.doc_id: np.log(r.score / (1 - r.score)) for r in toxicity.score(probe, toxicity.fit(docs, marks, counterfactual=strength)).collect()}
        lift[strength] = s[1] - s[2]
        assert s[3] - s[2] > 1 and s[4] > 0
    assert lift[20.0] < lift[0.0] / 3 or abs(lift[0.0]) < 0.01


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(60)] + [(1, "again")] * 50, DOCS)
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id bigint, toxic int")
    every = toxicity._sample(docs, marks, 1000, 1 << 20, 5).select("id", "h", "toxic").distinct().count()
    assert every == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60)) + (zlib.crc32(b"1") % 5 != 0)
    assert toxicity._sample(docs, marks, 7, 1 << 20, 5).select("id", "h", "toxic").distinct().count() == 7
    assert 3 <= toxicity._sample(docs, marks, 1000, 2500, 5).select("id", "h", "toxic").distinct().count() <= 7


def test_toxicity_hard(spark, hard, empty):
    labels = spark.createDataFrame([(3, 1), (None, 1), (5, None), (6, 0), (99, 1)], "doc_id bigint, toxic int")
    out = toxicity.score(hard, toxicity.fit(hard, labels)).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.score(hard, toxicity.fit(hard, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.0} and toxicity.score(empty, toxicity.fit(empty, labels)).isEmpty()
    assert toxicity.drop_toxic(hard, labels.limit(0)).count() == len(HARD)


# --- pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, bpe):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = table(spark)
    steps = []
    for name, stage in P.STAGES:
        before = docs
        docs = C.materialize(stage(spark, docs, SMALL), name)
        steps.append((before, docs))
        assert name == "packing" or docs.schema.simpleString() == before.schema.simpleString()
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    tox = rows(steps[0][1])
    model = toxicity.fit(table(spark), table(spark, "labels"))
    assert set(tox) == {r.doc_id for r in toxicity.score(table(spark), model).collect() if r.score < 0.5}
    near = rows(steps[1][1])
    assert set(near) == {k for k, (_, c) in brute_components([(k, r.text) for k, r in tox.items()], 5, 80).items() if k == c}
    clean = rows(steps[2][1])
    hits = brute_hits([(k, r.text) for k, r in near.items()], [(r.item_id, r.text) for r in table(spark, "benchmark").collect()])
    assert set(clean) == {k for k, _, h, _ in hits if not h}
    masked = rows(steps[3][1])
    assert set(masked) == set(clean)
    for k, r in masked.items():
        assert not brute_pii(r.text) and r.n_chars == len(r.text) and (brute_pii(clean[k].text) != [] or r.text == clean[k].text)
    total = {k: len(bpe.full.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in masked.items()}
    packed = Counter()
    for r in steps[4][1].collect():
        packed[r.doc_id] += r.length
    assert packed == total
