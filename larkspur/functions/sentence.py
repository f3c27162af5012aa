"""Sentence boundaries by the default rules of Unicode Standard Annex 29.

Rules are named as there: SB4 breaks after separators, SB5 ignores extending and format
characters, SB6 to SB8 keep a full stop within numbers, capitals and before lower case, SB8a
to SB10 take in what continues a sentence, closing marks and spaces, SB11 breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex


def _of(*names: str) -> str:
    return "".join(rf"\p{{Sentence_Break={n}}}" for n in names)


_SKIP = f"[{_of('Extend', 'Format')}]*"
_SEPARATOR = r"(?:\r\n|[\r\n\x85  ])"
#: A terminator with the closing marks, spaces and separator behind it, or a separator alone.
_END = regex.compile(rf"(?P<term>[{_of('STerm', 'ATerm')}]){_SKIP}(?P<close>(?:[{_of('Close')}]{_SKIP})*+)(?P<space>(?:[{_of('Sp')}]{_SKIP})*+)(?P<sep>{_SEPARATOR})?|{_SEPARATOR}")
_FULL_STOP = regex.compile(f"[{_of('ATerm')}]")
_NUMERIC, _UPPER = regex.compile(f"[{_of('Numeric')}]"), regex.compile(f"[{_of('Upper')}]")
_CASED_BEFORE = regex.compile(f"(?<=[{_of('Upper', 'Lower')}]{_SKIP})")
_LOWER_NEXT = regex.compile(f"[^{_of('OLetter', 'Upper', 'Lower', 'Sep', 'CR', 'LF', 'STerm', 'ATerm')}]*+[{_of('Lower')}]")
_CONTINUES = regex.compile(f"[{_of('SContinue', 'STerm', 'ATerm')}]")

#: Short forms whose full stop need not end a sentence; the default rules do not know them.
ABBREVIATIONS = regex.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\.g|i\.e|Inc|No)|\b[A-Z])\.$")


def bounds(text: str, abbreviations: regex.Pattern | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of ``text``, which follow each other without a gap.

    A sentence whose end ``abbreviations`` finds goes on, unless a line ends there.
    """
    start = 0
    for m in _END.finditer(text):
        end = m.end()
        if m["term"] and not m["sep"] and end < len(text):
            bare = not m["close"] and not m["space"]
            if _FULL_STOP.match(m["term"]):
                if bare and (_NUMERIC.match(text, end) or _UPPER.match(text, end) and _CASED_BEFORE.match(text, m.start())):  # SB6, SB7
                    continue
                if _LOWER_NEXT.match(text, end):  # SB8
                    continue
            if _CONTINUES.match(text, end):  # SB8a
                continue
            if abbreviations is not None and not m["close"] and abbreviations.search(text, max(start, m.start() - 16), m.start() + 1):
                continue
        yield start, end
        start = end
    if start < len(text):
        yield start, len(text)
