"""Rank-file BPE against one match at a time, on hard texts and across cuts."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import regex
from conftest import SMALL

from larkspur.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text: str) -> list[int]:
    enc = bpe.ranks(PATH, PATTERN).encoding
    return [i for m in regex.findall(PATTERN, text) for i in enc._encode_single_piece(m)]


HARD = [
    "", " ", "\n\n \t x", "it's we'll they'RE 'tis o'clock '9", "a1b2-3c", "naïve Ünïcode ß", "中文，没有空格。的句子！" * 5, "ひらがなカタカナ한국어", "👩‍👩‍👧‍👦 ‍", "\x1c\x1d \x85 \xa0　x",
    "é combining", "١٢٣ ⅷ ²", "<|endoftext|> stays text", "�", "x" * 300, "    indented\n\tcode();\n",
]


def test_ids_equal_one_match_at_a_time():
    enc = bpe.ranks(PATH, PATTERN)
    for t in HARD:
        assert enc.ids(t).tolist() == brute(t), t
        assert enc.bytes(enc.ids(t)) == t.encode()


def test_cuts_never_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "LONG_RUN", 5)
    import re

    monkeypatch.setattr(bpe, "_BLANKS", re.compile(rf"{bpe._BLANK}{{5,}}"))
    enc, rng = bpe.ranks(PATH, PATTERN), random.Random(5)
    signs = list("ab'sZ09 \n\t-.,;/@[`{~") + ["  ", " " * 9, "\n" * 7, "'ll", "é", "中", "，", "가", "　", "\x1c", "́", "²", "👍"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 60)))
        assert "".join(bpe.pieces(t, 7)) == t
        assert enc.ids(t).tolist() == brute(t), t


@pytest.mark.parametrize("text", [" " * 3_000_000 + "x", "\t " * 1_000_000, "\n" * 200_000 + "word", "ab1" * 400_000, "a" * 1_000_000, "word " * 500_000, "中" * 200_000, "!?" * 300_000], ids=["blanks", "mixed", "lines", "no space", "one word", "words", "east", "signs"])
def test_very_long_texts(text):
    enc = bpe.ranks(PATH, PATTERN)
    ids = enc.ids(text)
    assert enc.bytes(ids) == text.encode()
    if len(text) <= 1_200_000:
        assert ids.tolist() == brute(text)


def test_frames_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "one two", "kept", [9]), (1, "one two", "kept", [9]), (None, None, None, None), (2, "", "e", []), (3, "é" * 9, "é", [1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, ids array<int>")
    coded = bpe.encode(docs, PATH, PATTERN)
    assert sorted(coded.columns) == ["decoded", "doc_id", "ids", "text"]
    got = sorted(((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in bpe.decode(coded, PATH, PATTERN).collect()), key=repr)
    assert got == sorted(((i or 0, brute(t or ""), (t or "").encode()) for i, t, _, _ in rows), key=repr)
    raw = spark.sql("SELECT 1 AS doc_id, cast(X'61FF62' AS STRING) AS text")
    assert bytes(bpe.decode(bpe.encode(raw, PATH, PATTERN), PATH, PATTERN).first().decoded) == "a�b".encode()
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_query_against_one_match_at_a_time(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op12_bpe_roundtrip(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = brute(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
