import pytest
from hypothesis import given, settings, strategies as st

from larkspur.functions.sentence import ABBREVIATIONS, bounds
from larkspur.operators import ingest


def test_short_text_is_one_piece():
    assert ingest.chunk_text("abc") == [("abc", 0, 3, 0)]
    assert ingest.chunk_text("") == [] and ingest.chunk_text(None) == []


def test_sentences_keep_code_together():
    got = ingest.sentences("Hello there. How are you?\ndef f(x):\n\n    return g(x)\nBye.")
    assert [(s, c) for s, _, c in got] == [("Hello there.", False), ("How are you?", False), ("def f(x):\n\n    return g(x)", True), ("Bye.", False)]
    assert [o for _, o, _ in got] == [0, 13, 26, 53]


def test_abbreviations_end_no_sentence():
    text = "Dr. Smith met J. Doe. They left."
    assert [s for s, _, _ in ingest.sentences(text, ABBREVIATIONS)] == ["Dr. Smith met J. Doe.", "They left."]
    assert [s for s, _, _ in ingest.sentences(text)] == ["Dr.", "Smith met J.", "Doe.", "They left."]  # the default rules know none


def test_long_sentence_is_cut_at_characters():
    pieces = ingest.chunk_text("é" * 2000)
    assert all(len(p.encode()) <= 1200 for p, *_ in pieces) and "".join(p for p, *_ in pieces) == "é" * 2000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é", min_size=1, max_size=60).map(lambda s: s.strip() or "x"), min_size=1, max_size=80))
def test_pieces_cover_every_sentence(parts):
    text = ". ".join(parts) + "."
    pieces = ingest.chunk_text(text)
    assert [i for *_, i in pieces] == list(range(len(pieces)))
    whole = "".join(p for p, *_ in pieces)
    for s, _, _ in ingest.sentences(text) if len(pieces) > 1 else []:
        assert s in whole
    assert all(len(p.encode()) <= 1200 + 400 + 200 for p, *_ in pieces)


def test_prepare_splits_and_tags(spark):
    long = "One sentence here. " * 150
    rows = spark.createDataFrame([("t1", "p", "doc", "e1", ["x"], long, 5), ("t1", "p", "general", None, None, "short", 6)], "tenant_id string, project_id string, chunk_type string, episode_id string, tags array<string>, text string, timestamp_created bigint")
    out = ingest.prepare(rows).collect()
    assert {r.chunk_type for r in out} == {"doc", "other"} and len({r.chunk_id for r in out}) == len(out) > 2
    split = [r for r in out if r.chunk_type == "doc"]
    assert all(r.tags[:2] == ["episode:e1", "x"] and any(t.startswith("char_start:") for t in r.tags) for r in split)
    assert sorted(r.chunk_id for r in ingest.prepare(rows).collect()) == sorted(r.chunk_id for r in out)
    bad = spark.createDataFrame([("t 1", "doc", None), ("t", "nope", None), ("t", "doc", "a b"), ("t", "doc", "ok")], "tenant_id string, chunk_type string, episode_id string")
    assert sorted(r.reason for r in ingest.invalid(bad).collect()) == ["episode", "tenant", "type"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hello. World", ["Hello. ", "World"]), ("It cost 3.5 dollars.", ["It cost 3.5 dollars."]), ("etc. and so on", ["etc. and so on"]), ("the U.S.A is", ["the U.S.A is"]), ("Mr.Fox ran", ["Mr.Fox ran"]),
        ('He said "Go." She left.', ['He said "Go." ', "She left."]), ("(Really?) Yes! \u201cNo.\u201d Then", ["(Really?) ", "Yes! ", "\u201cNo.\u201d ", "Then"]), ('"Stop!" he cried.', ['"Stop!" ', "he cried."]), ('"Stop." he cried.', ['"Stop." he cried.']),
        ("\u4eca\u65e5\u306f\u3002\u660e\u65e5\uff01\u300c\u306f\u3044\u3002\u300d\u6b21", ["\u4eca\u65e5\u306f\u3002", "\u660e\u65e5\uff01\u300c", "\u306f\u3044\u3002\u300d", "\u6b21"]), ("\u0939\u093e\u0964 \u0928", ["\u0939\u093e\u0964 ", "\u0928"]),
        ("Wait... what? No", ["Wait... what? ", "No"]), ("Wait... What", ["Wait... ", "What"]), ("Hm\u2026 Yes", ["Hm\u2026 Yes"]), ("One?! Two", ["One?! ", "Two"]), ("a.\u0301 B", ["a.\u0301 ", "B"]), ("x. (1) then", ["x. (1) then"]), ("x. 1 Then", ["x. ", "1 Then"]),
        ("one\r\ntwo\u2028three\x85", ["one\r\n", "two\u2028", "three\x85"]), ("End. , more", ["End. , more"]), ("a. \u2029b", ["a. \u2029", "b"]), ("No break", ["No break"]), ("", []), ("...", ["..."]),
    ],
)
def test_sentence_rules(text, want):
    assert [text[a:b] for a, b in bounds(text)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.?!,;:\"')( \n\r\u2028\u3002\u0301\u00ad\u201d\u6f22", max_size=60))
def test_sentences_tile_the_text_by_the_rules(text):
    """Against the rules read one by one over the classes of all characters."""
    import regex

    names = ["CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "SContinue", "STerm", "Close"]
    of = [next((n for n in names if regex.match(rf"\p{{Sentence_Break={n}}}", c)), "Other") for c in text]
    cuts = []
    for i in range(1, len(text)):
        if of[i - 1] == "CR" and of[i] == "LF":
            continue
        if of[i - 1] in ("Sep", "CR", "LF"):
            cuts.append(i)
            continue
        if of[i] in ("Extend", "Format"):
            continue
        left = [c for j, c in enumerate(of[:i]) if c not in ("Extend", "Format") or j == 0 or of[j - 1] in ("Sep", "CR", "LF")]
        right = [of[i], *(c for c in of[i + 1 :] if c not in ("Extend", "Format"))]
        k = len(left) - 1
        seps = left[k] in ("Sep", "CR", "LF")
        while k >= 0 and left[k] == "Sp":
            k -= 1
        spaces = k < len(left) - 1
        while k >= 0 and left[k] == "Close":
            k -= 1
        if seps or k < 0 or left[k] not in ("ATerm", "STerm"):
            continue
        near = k == len(left) - 1
        if left[k] == "ATerm":
            if near and (right[0] == "Numeric" or right[0] == "Upper" and k and left[k - 1] in ("Upper", "Lower")):
                continue
            ahead = next((c for c in right if c in ("OLetter", "Upper", "Lower", "Sep", "CR", "LF", "STerm", "ATerm")), None)
            if ahead == "Lower":
                continue
        if right[0] in ("SContinue", "STerm", "ATerm") or right[0] in ("Sp", "Sep", "CR", "LF") or right[0] == "Close" and not spaces:
            continue
        cuts.append(i)
    found = list(bounds(text))
    assert [b for _, b in found[:-1]] == cuts
    assert "".join(text[a:b] for a, b in found) == text


def test_uncovered_words_are_found(spark):
    from pyspark.sql import functions as F

    from larkspur.plans.structure import uncovered

    texts = ["One sentence here. " * 150, "Zwei S\u00e4tze! " * 200, "... " * 400, "short", "x" * 5000]
    rows = spark.createDataFrame([("t", t) for t in texts], "tenant_id string, text string")
    assert uncovered(rows).isEmpty()

    def lossy(docs, key):
        return ingest.split_chunks(docs, key).withColumn("end_char", F.col("end_char") - 40)

    assert not uncovered(rows, lossy).isEmpty()
    assert uncovered(rows, lambda docs, key: ingest.split_chunks(docs, key).limit(0)).count() == 3


def test_word_bits():
    import re

    import numpy as np

    for text in ("", "a. b", "Sätze! 今日は。 \U0001d7d8x ́ ½_ ", "... " * 9, "é—\U0001f600z"):
        raw = text.encode()
        want = np.zeros((len(raw) + 7) // 8 * 8, bool)
        for m in re.finditer(r"[^\W_]|½", text):
            a = len(text[: m.start()].encode())
            want[a : a + len(m[0].encode())] = True
        assert np.unpackbits(np.frombuffer(ingest.word_bits(text), np.uint8), bitorder="little").astype(bool).tolist() == want.tolist()


def test_prepare_and_uncovered_shuffle_no_text(spark, capsys):
    """Rows become pieces where they stand, equal rows count their own pieces, and only bits and hashes are dealt."""
    from larkspur.plans.structure import uncovered

    long = "One sentence here. " * 150
    row = ("t1", "p", "doc", None, [], long, 5)
    rows = spark.createDataFrame([row, row, ("t1", "p", "doc", None, [], "y" * 1100, 6), (None, "p", "doc", None, [], None, 6)], "tenant_id string, project_id string, chunk_type string, episode_id string, tags array<string>, text string, timestamp_created bigint")
    ready = ingest.prepare(rows)
    ready.explain()
    assert "Exchange" not in capsys.readouterr().out
    got = ready.collect()
    n = len(ingest.chunk_text(long))
    assert len(got) == 2 * n + 1 and {r.chunk_id for r in got if r.tags} == {r.chunk_id for r in got if r.text[0] == "O"}
    assert all(f"total_chunks:{n}" in r.tags for r in got if r.text[0] == "O") and [r.tags for r in got if r.text[0] == "y"] == [[]]
    uncovered(rows).select("tenant_id").distinct().explain()
    assert "Join" not in capsys.readouterr().out
    lost = uncovered(rows, lambda docs, key: ingest.split_chunks(docs, key).where("chunk_index <> 1")).collect()
    assert len(lost) == 1 and lost[0].tenant_id == "t1" and lost[0].gap.strip() in long and len(lost[0].gap) > 400
