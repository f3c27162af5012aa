"""Personal data with offset-preserving deobfuscation.

Two layers of detectors.  The base detectors run on the source text.  Then a chain of
transducers writes a normalised text next to the source: homoglyphs and full-width forms
become ASCII, zero-width characters vanish, spelled digits become digits, and disguised
``at`` and ``dot`` become their signs.  Every normalised character keeps the source range
it came from, so what the same detectors find there is mapped back to source characters.
Base spans stay as they are.  Found spans inside a base span of any kind are dropped; those
that reach beyond one are reported next to it.

Only texts with a trigger (a character of another script, three spelled digits, an @, a
boxed or spelled sign) go through the transducers.  The triggers are found with byte kernels
and leave out only texts that no transducer would change.

Kinds, in order: email, ip, card, phone.  Offsets are code points, ends exclusive.
Defined results: null and empty texts have no spans; repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import common as C

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so a text without @ costs one search."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            done = m.end()
            out.append((s, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Groups of four parts of each maximal dotted run, which is what leftmost matching gives."""
    out = []
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


DETECT = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    return [(k, s, e) for k, find in enumerate(DETECT) for s, e in find(text)]


# --- transducers ---------------------------------------------------------------------

#: Letters and signs of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһԛԝьАВЕКМНОРСТУХІЈЅ" "αεικνορτυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɡɑ" "–—‐‑‒−․。．＠﹫٫",
        "aeopcyxijsdhqwbABEKMHOPCTYXIJS" "aeikvoptuxyABEZHIKMNOPTYX" "iga" "------...@@.",
        strict=True,
    )
)
#: Spelled digits of the four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = r"(?:at|ät|arroba|arobase)"
_DOT = r"(?:dot|punto|punkt|point)"
_OPEN, _CLOSE = r"[\[\(\{<]\s*", r"\s*[\]\)\}>]"
_LABEL = r"[A-Za-z0-9-]+"
_AT_WORDS = ("at", "ät", "arroba", "arobase")
_DOT_WORDS = ("dot", "punto", "punkt", "point")
#: a match takes the white space before it whole, so that long runs are read once
_BEFORE = r"(?:(?<!\s)\s+)"
_AT_BOXED = re.compile(rf"{_BEFORE}?{_OPEN}(?:{_AT}|@){_CLOSE}\s*|{_BEFORE}@\s*|{_BEFORE}?@\s+", re.I)
_AT_BARE = re.compile(rf"{_BEFORE}{_AT}\s+(?={_LABEL}(?:\s*{_OPEN}(?:{_DOT}|\.){_CLOSE}\s*|\s+{_DOT}\s+){_LABEL})", re.I)
_DOT_ANY = re.compile(rf"\s*{_OPEN}(?:{_DOT}|\.){_CLOSE}\s*|\s+{_DOT}\s+", re.I)  # only matched at a given place
_DOT_WIDE = re.compile(r"\s+\.\s+|\s+\.(?=[A-Za-z0-9])")
_SPELL = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus|{_SPELL}|double|triple)(?!\w)|\+|[0-9]+)(?:[\s.,()-]*(?:(?<!\w)(?:{_SPELL}|double|triple|{_DOT})(?!\w)|[0-9]+))+", re.I)
_TOKEN = re.compile(rf"(?<!\w)(?:plus|{_SPELL}|double|triple|{_DOT})(?!\w)|\+|[0-9]+|[.()-]", re.I)


class Mapped:
    """A text whose every character knows the source range [start, end) it stands for."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None):
        self.text = text
        self.starts = array("q", range(len(text))) if starts is None else starts
        self.ends = array("q", range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace ranges of this text; the new characters of an edit share its whole source range."""
        if not edits:
            return self
        parts, starts, ends, at = [], array("q"), array("q"), 0
        for s, e, new in edits:
            parts += [self.text[at:s], new]
            starts += self.starts[at:s] + array("q", [self.starts[s]]) * len(new)
            ends += self.ends[at:s] + array("q", [self.ends[e - 1]]) * len(new)
            at = e
        parts.append(self.text[at:])
        return Mapped("".join(parts), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def fold_glyphs(m: Mapped) -> Mapped:
    """Homoglyphs and full-width forms to ASCII; zero-width and soft-hyphen characters to nothing."""
    edits = []
    for i, ch in enumerate(m.text):
        if ch < "\x80":
            continue
        to = HOMOGLYPHS.get(ch)
        if to is None:
            if unicodedata.category(ch) == "Cf":
                to = ""
            elif ord(ch) > 0x2000:
                wide = unicodedata.normalize("NFKC", ch)
                to = wide if wide.isascii() else None
            elif unicodedata.decimal(ch, None) is not None:
                to = str(unicodedata.decimal(ch))
        if to is not None:
            edits.append((i, i + 1, to))
    return m.rewrite(edits)


def digits_from_words(m: Mapped) -> Mapped:
    """Runs of spelled digits (with plus, double, triple and dots) to digits and their signs."""
    edits = []
    for run in _SPELLED_RUN.finditer(m.text):
        tokens = [(t.start(), t.end(), t.group().lower()) for t in _TOKEN.finditer(m.text, run.start(), run.end())]
        if sum(t.isalpha() and t != "plus" for _, _, t in tokens) < 3:
            continue
        times, last = 1, None
        for s, e, t in tokens:
            if t in ("double", "triple"):
                times, gap = (2 if t == "double" else 3), s
                last = gap if last is None else last
                continue
            new = SPELLED.get(t, "+" if t == "plus" else "." if not t[0].isdigit() and t.isalpha() else t)
            begin = last if times > 1 and last is not None else s
            # what stands between two tokens (spaces, commas) goes with the later one
            if edits and edits[-1][1] < begin and run.start() <= edits[-1][1] and not m.text[edits[-1][1] : begin].strip(" \t\n,"):
                begin = edits[-1][1]
                edits.append((begin, e, new * times))
            else:
                edits.append((begin, e, new * times))
            times, last = 1, None
    return m.rewrite([x for x in edits if x[0] < x[1]])


def signs_from_words(m: Mapped) -> Mapped:
    """Disguised at and dot to @ and '.', only next to each other's shape of an address."""
    at = [(x.start(), x.end(), "@") for p in (_AT_BOXED, _AT_BARE) for x in p.finditer(m.text) if x.start() > 0 and m.text[x.start() - 1] in _LOCAL and x.end() < len(m.text) and m.text[x.end()].isalnum()]
    if not at and "@" not in m.text:
        return m
    at.sort()
    kept, done = [], 0
    for s, e, new in at:
        if s >= done:
            kept.append((s, e, new))
            done = e
    m = m.rewrite(kept)
    edits, n = [], len(m.text)
    for i in (i for i, ch in enumerate(m.text) if ch == "@"):
        s = i  # dots of the local part
        while s > 0:
            while s > 0 and m.text[s - 1] in _LOCAL:
                s -= 1
            d = next((x for x in _DOT_ANY.finditer(m.text, max(0, s - 24), s) if x.end() == s), None)
            if not d or d.start() == 0 or m.text[d.start() - 1] not in _LOCAL:
                break
            edits.append((d.start(), d.end(), "."))
            s = d.start()
        e = i + 1  # dots of the domain
        while e < n:
            label = re.compile(_LABEL).match(m.text, e)
            if not label:
                break
            e = label.end()
            d = _DOT_ANY.match(m.text, e) or (_DOT_WIDE.match(m.text, e) if m.starts[i] + 1 != m.ends[i] else None)
            if d and d.end() < n and m.text[d.end()].isalnum():
                edits.append((d.start(), d.end(), "."))
                e = d.end()
            elif e < n and m.text[e] == ".":
                e += 1
            else:
                break
    return m.rewrite(sorted(set(edits)))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows, in source offsets: none inside a base span, nor inside a longer one of its kind."""
    folded = fold_glyphs(Mapped(text))
    found: dict[tuple[int, int, int], None] = {}
    for variant in (folded, signs_from_words(folded), digits_from_words(folded), signs_from_words(digits_from_words(folded))):
        if variant.text == text:
            continue
        for k, s, e in base_spans(variant.text):
            a, b = variant.source(s, e)
            if k in (2, 3) and len(set(_digits(variant.text[s:e]))) < 2 and text[a:b] != variant.text[s:e]:
                continue
            found.setdefault((k, a, b))
    out: list[tuple[int, int, int]] = []
    covered, reach = 0, [0] * len(KINDS)  # ends of what began so far: base spans, and added spans by kind
    for s, e, more, k in sorted([(s, -e, 0, k) for k, s, e in base] + [(s, -e, 1, k) for k, s, e in found]):
        if not more:
            covered = max(covered, -e)
        elif -e > max(covered, reach[k]):
            out.append((k, s, -e))
            reach[k] = -e
    return out


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return np.unique(C.span_hash(C.prefix_hash(data), offs[:-1], offs[1:]))


_BRACKETS = np.zeros(256, bool)
_BRACKETS[[ord(ch) for ch in "[({<"]] = True
#: \s below U+0250 (also both bytes of U+0085 and U+00A0)
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0x85, 0xA0]] = True
_ODD_PAIRS = np.array([0xC2AD, 0xC4B0, 0xC4B1, 0xC5BF], np.uint16)


def _boxed(data: np.ndarray) -> np.ndarray:
    """Positions of the first bytes behind opening brackets and white space."""
    box = np.flatnonzero(_BRACKETS[data])
    if not len(box):
        return box
    solid = np.flatnonzero(~_BLANK[data])
    k = np.searchsorted(solid, box, "right")
    return solid[k[k < len(solid)]]


def _rows_with(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] > total[offs[:-1]]


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of texts below U+0250; U+0080 to U+00BF, multiplication and division sign become spaces."""
    low = C.LOWER[data]
    lead = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xC3))
    after = data[lead + 1]
    sign = (data[lead] == 0xC2) | (after == 0x97) | (after == 0xB7)
    low[lead[sign]] = low[lead[sign] + 1] = 32
    capital = ~sign & (after >= 0x80) & (after <= 0x9E)
    low[lead[capital] + 1] += 32
    return low


def triggers(data: np.ndarray, offs: np.ndarray, ats: np.ndarray, dots: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: may it hold a base span, and may a transducer change it."""
    base = _rows_with((data == 64) | ((data >= 48) & (data <= 57)), offs)
    # lead bytes from U+0250 on, look-alikes included; below it the soft hyphen (C2 AD) and what folds or matches without case as i or s (C4 B0, C4 B1, C5 BF)
    odd = (data == 64) | (data >= 0xC9)
    lead = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xC4) | (data[:-1] == 0xC5))
    pair = data[lead].astype(np.uint16) << np.uint16(8) | data[lead + 1]
    odd[lead[np.isin(pair, _ODD_PAIRS)]] = True
    deep = _rows_with(odd, offs)
    low = _lower(data)
    starts, ends, first = C.word_spans(low, offs, C.ALNUM)
    short = np.flatnonzero(ends - starts <= 8)
    if len(short):
        h = C.span_hash(C.prefix_hash(low), starts[short], ends[short])
        row = np.searchsorted(first, short, "right") - 1
        deep[row[np.isin(h, dots)]] = True
        is_at = np.isin(h, ats)
        # a boxed at stands behind a bracket; a bare one needs a dot as well, spelled (seen above) or boxed
        boxed = _boxed(data)
        deep[row[is_at & np.isin(starts[short], boxed)]] = True
        dot = boxed[data[boxed] == 46]
        if len(dot):
            has_at = np.zeros(len(offs) - 1, bool)
            has_at[row[is_at]] = True
            has_dot = np.zeros(len(data), bool)
            has_dot[dot] = True
            deep |= has_at & _rows_with(has_dot, offs)
        deep |= np.bincount(row[np.isin(h, spelled)], minlength=len(offs) - 1) >= 3
    return base, deep


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(batch: pa.RecordBatch, name: str) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(text, base spans, added spans) of every row; the text is empty where no span is possible."""
    ats, dots, spelled = _hashes(_AT_WORDS), _hashes(_DOT_WORDS), _hashes((*SPELLED, "double", "triple"))
    col = batch.column(name)
    for a, _, data, offs in C.chunks(batch, name):
        base, deep = triggers(data, offs, ats, dots, spelled)
        for i in range(len(offs) - 1):
            if not (base[i] or deep[i]):
                yield "", [], []
                continue
            text = col[a + i].as_py() or ""
            own = base_spans(text) if base[i] else []
            yield text, own, added_spans(text, own) if deep[i] else []


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    The counts and ``base_sha256`` are of the base spans; ``spans`` lists all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, spans, added = [], [], []
            for _, own, more in find(batch, "text"):
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[0] == k for x in own))
                sha.append(hashlib.sha256(_join(own).encode()).hexdigest())
                spans.append(_join(own + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Rows of ``docs`` with every span replaced by its kind in brackets; ``length_col``, if there, follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            changed = {}
            for i, (text, own, more) in enumerate(find(batch, text_col)):
                if own or more:
                    parts, at = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in own + more):
                        if e > at:
                            parts += [text[at : max(s, at)], f"[{KINDS[k].upper()}]" if s >= at else ""]
                            at = e
                    changed[i] = "".join(parts) + text[at:]
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(changed.values()), column.type))
                at = batch.schema.get_field_index(text_col)
                batch = batch.set_column(at, batch.schema.field(at), column)
                if length_col in batch.schema.names:
                    k = batch.schema.get_field_index(length_col)
                    own_type = batch.schema.field(k).type
                    sizes = pa.array([len(x) for x in changed.values()]).cast(own_type)
                    batch = batch.set_column(k, batch.schema.field(k), pc.replace_with_mask(batch.column(k), pa.array(mask), sizes))
            yield batch

    return docs.mapInArrow(run, docs.schema)
