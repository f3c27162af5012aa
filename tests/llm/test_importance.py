"""Importance resampling against a plain version, with long words, long texts, nulls and ties."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from conftest import SMALL
from oracle import differences

from larkspur.llm import importance as I, queries, sql

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % I.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, min_words=20, seed=42):
    mine, theirs = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = (np.bincount([x for _, f in side for x in f], minlength=I.BUCKETS) for side in (mine, theirs))
    gain = [math.floor(1000 * math.log((y + 1) * (float(s.sum()) + I.BUCKETS) / ((x + 1) * (float(t.sum()) + I.BUCKETS)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for (i, _), (n, f) in zip(docs, mine, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


def drawn(spark, docs, target, **kw):
    df = spark.createDataFrame([(i, t, 5, 7, "x") for i, t in docs], "doc_id bigint, text string, rank int, weight int, id string")
    return sorted((tuple(r) for r in I.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **kw).collect()), key=repr)


def texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "çedille", "δ", "2024", "x" * 127, "y" * 128, "z" * 129, "w" * 400, "gamma", "GAMMA", "éÉ"]
    return [rng.choice(["", " ", ", ", "-"]).join(rng.choice(words) + rng.choice([" ", "\n", "... ", "\t_"]) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_equals_sql(spark):
    assert differences(spark, queries.op13_importance_resampling, sql.IMPORTANCE, SMALL) == ""


def test_brute_force_with_nulls_ties_and_repeats(spark):
    docs = list(enumerate(texts(150))) + [(None, None), (None, texts(1, 9)[0]), (7, None), (8, ""), (9, " .,; ")]
    docs += [(500, "tie " * 30)] * 4 + [(None, "tie " * 30)] * 2
    for percent in (5, 50, 100):
        assert drawn(spark, docs, [*texts(20, 2), None, ""], percent=percent) == brute(docs, [*texts(20, 2), None, ""], percent)


def test_empty_tables(spark):
    docs = list(enumerate(texts(30)))
    assert drawn(spark, [], texts(3)) == []
    assert drawn(spark, docs, [], percent=40) == brute(docs, [], 40)


def test_long_texts_in_segments():
    """Cutting one text at any place keeps every run."""
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "c", "D", "é", " ", ".", "\n", "q" * 40]) for _ in range(400))
        batch = pa.RecordBatch.from_pydict({"text": pa.array([text])})
        found = [b for _, data, offs, lead in I._segments(batch, "text", 16) for bucket in I.runs(data, offs)[0] for b in bucket[lead:][bucket[lead:] >= 0]]
        assert sorted(found) == sorted(features(text)[1])


def test_a_very_long_text(spark):
    docs = [(1, "Some words, again and again. " * 150_000), (2, "v" * 3_000_000), (3, "w" * 2_500_000 + " end")]
    assert drawn(spark, docs, ["some words"], percent=100) == brute(docs, ["some words"], 100)


def test_crc_register():
    data = np.frombuffer(b"The quick brown fox" * 40, np.uint8)
    starts, sizes = np.array([0, 4, 10, 3, 100]), np.array([3, 5, 0, 500, 128])
    state = I.advance(np.full(5, 0xFFFFFFFF, np.uint32), data, starts, sizes)
    assert [int(~x & np.uint32(0xFFFFFFFF)) for x in state] == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]
