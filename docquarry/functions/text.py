"""Text expressions: folding, tokens, query sanitising, stripping, escaping."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> dict[str, tuple[str, str]]:
    """Letters that are one ASCII letter with one mark, as (letter, mark), by their public decomposition; a letter with two marks is one of its own."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x1F00)}
    return {ch: (d[0], d[1]) for ch, d in parts.items() if len(d) == 2 and d[0].isascii() and d[0].isalpha() and d[0].islower() and unicodedata.category(d[1]) == "Mn"}


_PARTS = _marked()
#: Letters with a mark and what they fold to (Spark has no function that removes marks), and forms of letters that count as others (fixed values).
MARKED = "".join(_PARTS) + "ςſϐϑϕϖϰϱϵ"
PLAIN = "".join(x for x, _ in _PARTS.values()) + "σsβθφπκρε"
#: Marks that belong to the letter before and are dropped; other marks part words.
MARKS = "".join(sorted({m for _, m in _PARTS.values()}))

#: Characters that a full-text query must not pass on as syntax (fixed values).
QUERY_SYNTAX = '"^*():-+'


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), MARKED + MARKS, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text, in order; a null text has none."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fold_python(text: str) -> str:
    return text.lower().translate(str.maketrans(MARKED, PLAIN, MARKS))


def tokens_python(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold_python(text)) if t]


def query_phrases(query: str | None) -> list[list[str]]:
    """Phrases (lists of tokens) that a text must hold, all of them; syntax characters part words, empty phrases go."""
    plain = "".join(" " if ch in QUERY_SYNTAX else ch for ch in query or "")
    return [p for p in (tokens_python(word) for word in plain.split()) if p]


def strip(c: Column) -> Column:
    """Without white space at either end (Spark's trim takes spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def snippet(c: Column, n: int = 320) -> Column:
    return F.substring(c, 1, n)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def last_n(a: Column, n: int) -> Column:
    """The last n entries of an array, or all of a shorter one."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def fixed(c: Column, digits: int = 3) -> Column:
    """A number with that many decimals and no grouping; null for null."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def list_to_json(c: Column) -> Column:
    """A list of texts as it is stored in a text column; null for null."""
    return F.to_json(c)


def list_from_json(c: Column) -> Column:
    """The list that list_to_json wrote; what is no list of texts is null."""
    return F.from_json(c, "array<string>")
