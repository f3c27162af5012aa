"""Texts that once cost time or memory far beyond their size, in decontamination and HTML extraction."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from larkspur.llm import decontaminate as D, html


def spans(block, words):
    """Hit ranges, items and longest match of one text, as the operator finds them."""
    import pyarrow as pa

    found = []

    class Rows:
        dtypes = [("id", "bigint")]

        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                @staticmethod
                def broadcast(x):
                    return type("B", (), {"value": x})

        def mapInArrow(self, run, ddl):  # noqa: N802
            batch = pa.RecordBatch.from_pydict({"id": pa.array([1]), "h": pa.array([1]), "text": pa.array([" ".join(words)])})
            found.extend(r for b in run([batch]) for r in b.to_pylist())

    D._hits(Rows(), block, True)
    return found[0]


def brute(items, words, window):
    hit, of, best = set(), set(), (0, 0)
    for item, text in items:
        w = text.split()
        m = min(window, len(w))
        for i in range(len(words)):
            for k in range(len(w) - m + 1) if w else ():
                n = 0
                while i + n < len(words) and k + n < len(w) and words[i + n] == w[k + n]:
                    n += 1
                if n >= m:
                    hit |= set(range(i, i + n))
                    of.add(item)
                    best = max(best, (n, -i))
    return hit, of, best


@pytest.mark.parametrize("window", [1, 2, 4])
def test_windows_and_longest_matches_against_brute_force(window):
    rng = random.Random(window)
    for _ in range(60):
        letters = "abc"[: rng.randrange(1, 4)]
        items = [(str(i), " ".join(rng.choice(letters + "z") for _ in range(rng.randrange(0, 9)))) for i in range(rng.randrange(1, 5))]
        words = [rng.choice(letters + "q") for _ in range(rng.randrange(0, 40))]
        got = spans(D.Suffixes([i for i, _ in items], [t for _, t in items], window), words)
        hit, of, (n, at) = brute(items, words, window)
        assert {p for a, b in zip(got["starts"], got["ends"], strict=True) for p in range(a, b)} == hit
        assert set(got["items"]) == of and len(got["items"]) == len(of)
        assert (got["longest"], got["longest_at"]) == ((n, -at) if n else (0, -1))


def test_equal_words_make_no_pairs():
    start = time.time()
    block = D.Suffixes(["1", "2"], ["word " * 10_000, "word " * 500 + "end"], 10)
    got = spans(block, ["word"] * 200_000)
    assert (got["starts"], got["ends"], sorted(got["items"]), got["longest"], got["longest_at"]) == ([0], [200_000], ["1", "2"], 10_000, 0)
    assert time.time() - start < 20


@pytest.mark.parametrize("piece", ["<a ", "<div a='", '<div a="x', "<p class=\"", "<b a='>'", "<a href=x", "</a ", "<!-", "<!--", "<!--x>", "<![CDATA[", "<?x "])
def test_a_megabyte_of_open_tags(piece):
    start = time.time()
    page = "<article><p>First words of the page stand here.</p></article>" + piece * (1_000_000 // len(piece))
    assert "First words of the page stand here." in html.main_text(page)
    assert time.time() - start < 20


def test_settle_leaves_whole_tags_alone():
    for page in ("<p a='1>2' b=\"x'y\">t</p>", "<p title=it's>x</p>", "no tags", "", "a < b > c", "<img src=\"data:" + "x" * 100_000 + "\">", "<a\n href = 'x' >"):
        assert html.settle(page) == page
    assert html.settle("x <a b") == "x &lt;a b" and html.settle("<p>x <a b='y") == "<p>x &lt;a b='y"
    assert html.settle("<a <a <b>") == "<a <a <b>" and html.settle("<!-- <p>x</p> -->") == "<!-- <p>x</p> -->"
    assert html.settle("<!-- <p>x</p> </a") == "&lt;!-- <p>x</p> &lt;/a"


def test_settle_against_a_scan_of_each_tag():
    rng = random.Random(8)
    for _ in range(3000):
        page = "".join(rng.choice(["<a", "<b ", "'", '"', "=", " ", ">", "x", "='", '="', "< "]) for _ in range(rng.randrange(0, 25)))
        want = []
        for i, ch in enumerate(page):
            closed, j = False, i + 1
            while ch == "<" and page[i + 1 : i + 2].isalpha() and j < len(page):
                if page[j] == ">":
                    closed = True
                    break
                if page[j] in "\"'" and page[:j].rstrip().endswith("=") and "=" in page[i + 1 : j]:
                    j = page.find(page[j], j + 1)
                    if j < 0:
                        break
                j += 1
            want.append("&lt;" if ch == "<" and page[i + 1 : i + 2].isalpha() and not closed else ch)
        assert html.settle(page) == "".join(want), page


def test_covered():
    assert D.covered(np.array([0, 2, 2]), np.array([1, 2, 4]), 5).tolist() == [True, False, True, True, False]
