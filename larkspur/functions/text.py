"""String scalars: tokens, code detection, identifiers, hashes, validation and repair."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from larkspur.schemas import CHUNK_TYPE_ALIASES, CHUNK_TYPES

#: Text fragments that mark a line as code, wherever they stand in it.
CODE_MARKERS = (
    "{", "}", "[", "]", ";",
    "fn ", "func ", "def ", "async fn", "pub fn", "pub(crate)",
    "let ", "const ", "var ", "mut ",
    "=>", "->", "::", ".unwrap()", ".await",
    "use ", "import ", "from ", "require(",
    "if (", "for (", "while (", "match ", "switch (",
    "//", "/*", "*/", "#[",
    ": &", ": Vec<", ": String", ": i32", ": u32", "-> Result", "-> Option",
)
CODE_STARTS = ("function ", "async function ")
SEPARATORS = r"[\s_.,;:!?'\"(){}\[\]<>=+\-*/\\|&^%$#@~`]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def camel_parts(word: Column) -> Column:
    """Parts of a camel-case identifier: a new one begins at a capital after a small letter or digit, and at the last capital of a run before a small letter."""
    marked = F.regexp_replace(word, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1~$2")
    marked = F.regexp_replace(marked, r"([\p{Ll}\p{N}])(\p{Lu})", "$1~$2")
    return F.filter(F.split(marked, "~"), lambda x: x != "")


def code_tokens(text: Column) -> Column:
    """Identifier-aware tokens as structs (text, token_type).

    White space, underscores and separators part words, camel case parts them again.  Two or
    more capitals are an acronym and stay; a lower-case word is prose; a single capital is
    mixed; everything else is code and lower-cased.
    """
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda x: x != "")
    parts = F.flatten(F.transform(pieces, camel_parts))

    def typed(t: Column) -> Column:
        acronym = t.rlike(r"^[A-Z]{2,}$")
        kind = F.when(acronym, "code").when(t.rlike(r"^[A-Z]$"), "mixed").when(t.rlike(r"^\p{Ll}+$"), "prose").otherwise("code")
        return F.struct(F.when(acronym, t).otherwise(F.lower(t)).alias("text"), kind.alias("token_type"))

    return F.transform(parts, typed)


def is_code_line(line: Column) -> Column:
    """Does the line look like source code: a marker, an assignment or call when indented, or a bracket or comma at its end."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    marked = F.lit(False)
    for m in CODE_MARKERS:
        marked = marked | F.contains(trimmed, F.lit(m))
    for m in CODE_STARTS:
        marked = marked | F.startswith(trimmed, F.lit(m))
    indented = line.rlike(r"^(    |\t)") & trimmed.rlike(r"[=(.]")
    closing = trimmed.rlike(r"[{};),]$") & (~F.contains(trimmed, F.lit(" ")) | (F.contains(trimmed, F.lit("(")) & F.contains(trimmed, F.lit(")"))))
    return (trimmed != "") & (marked | indented | closing)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def repair_query(query: Column) -> Column:
    """Letters and digits only, single spaces, lower case; null where that changes nothing or leaves nothing."""
    fixed = F.lower(F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}]+", " ")))
    return F.when((fixed != "") & (fixed != query), fixed)


def adaptive_fetch_k(query: Column, k: Column, filtered: Column, most: int = 100) -> Column:
    """Candidate depth: the most under filters; twice k for long queries; else k."""
    n_words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda x: x != ""))
    long = (n_words >= 6) | (F.octet_length(query) >= 80)
    return F.when(filtered, F.lit(most)).when(long, F.least(F.greatest(2 * k, F.lit(1)), F.lit(most))).otherwise(k)


#: What varies in error messages, and what stands for it.
SIGNATURE = ((r"0x[0-9a-fA-F]+", "0x..."), (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<timestamp>"), (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"))
SIGNATURE_BYTES = 200


def normalize_signature(message: Column) -> Column:
    """Error signature: hex numbers, timestamps and UUIDs replaced; over 200 bytes, as many whole characters as fit and an ellipsis."""
    s = message
    for pattern, to in SIGNATURE:
        s = F.regexp_replace(s, pattern, to)
    raw = F.encode(s, "UTF-8")
    end = F.lit(SIGNATURE_BYTES)
    for back in (2, 1, 0):  # the last place that no character reaches over
        inside = F.hex(F.substring(raw, SIGNATURE_BYTES - back + 1, 1)).rlike("^[89AB]")
        end = F.when(~inside, SIGNATURE_BYTES - back).otherwise(SIGNATURE_BYTES - 3 if back == 2 else end)
    cut = F.decode(F.substring(raw, F.lit(1), end), "UTF-8")
    return F.when(F.octet_length(s) > SIGNATURE_BYTES, F.concat(cut, F.lit("..."))).otherwise(s)


def episode_of(tags: Column) -> Column:
    """Value of the first ``episode:`` tag, or null."""
    first = F.try_element_at(F.filter(tags, lambda t: t.startswith("episode:")), F.lit(1))
    return F.substring(first, len("episode:") + 1, 1 << 20)


def tag_number(tags: Column, prefix: str) -> Column:
    """Number behind the first tag with ``prefix``, or null."""
    first = F.try_element_at(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(1))
    return F.regexp_extract(first, r"^[^:]+:(\d+)$", 1).try_cast("int")


def valid_tenant(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_]+$"), F.lit(False))


def valid_uuid(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def valid_episode(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False))


def chunk_type(name: Column) -> Column:
    """Canonical chunk type, or null for an unknown one."""
    low = F.lower(name)
    out = low
    for alias, to in CHUNK_TYPE_ALIASES.items():
        out = F.when(low == alias, to).otherwise(out)
    return F.when(out.isin(*CHUNK_TYPES), out)


def check_tenant(name: str) -> str:
    """Driver-side form of ``valid_tenant``."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name or ""):
        raise ValueError(f"tenant id {name!r}: letters, digits and underscores only, at least one")
    return name


def check_k(k: int, most: int = 100) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k is {k}; it must be from 1 to {most}")
    return k


def check_range(start: int | None, end: int | None) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError(f"time range starts at {start} after it ends at {end}")
