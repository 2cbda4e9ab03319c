"""Chunks of bounded token counts from a document's blocks.

Splitting and packing run per document in an Arrow UDF (a fold over one document's blocks; documents are independent).
The default tokenizer counts runs of letters and digits and every other non-space character.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import slices
from docquarry.plans.schemas import CHUNK

TOKEN = r"[^\W_]+|[^\w\s]|_"
#: Room for special tokens and for breadcrumbs, and the least budgets (fixed values).
SPECIAL, CRUMB_ROOM, LEAST_BUDGET = 4, 70, 32
MODEL_MAX = 512

_token = re.compile(TOKEN)


def default_spans(text: str) -> list[tuple[int, int]]:
    """The default tokenizer: places of the tokens of a text."""
    return [m.span() for m in _token.finditer(text)]


def default_sentences(text: str) -> list[str]:
    """The default sentence splitter: sentences end with . ! or ? before white space."""
    return [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0)))


#: Places where a text may be cut after punctuation (fixed value).
PUNCTUATION = re.compile(r"(?<=[.;:,])\s+")

def _ruled(line: str) -> bool:
    """Whether a line parts a table's head from its rows: pipes at both ends and between them, once at least, pipes, hyphens, colons or spaces alone."""
    text = line.strip()
    return len(text) > 2 and text[0] == text[-1] == "|" and set(text) <= set("|-: ")


def budget(max_tokens: int = 500, overlap: int = 100, model_max: int = MODEL_MAX) -> tuple[int, int]:
    """(largest body, the model's limit)."""
    limit = min(model_max, MODEL_MAX)
    return max(LEAST_BUDGET, min(max_tokens, limit - overlap - CRUMB_ROOM - SPECIAL)), limit


class Chunker:
    """Splitting and packing with a tokenizer (text -> places of its tokens) and a sentence splitter (text -> sentences) of one's choice."""

    def __init__(self, spans: Callable[[str], list[tuple[int, int]]] = default_spans, sentences: Callable[[str], list[str]] = default_sentences):
        self.spans, self.sentences = spans, sentences
        self.splitters = {"table": self.split_rows, "list": self.split_lines, "code": self.split_lines, "paragraph": self.split_sentences, "caption": self.split_sentences}

    def count(self, text: str) -> int:
        return len(_token.findall(text)) if self.spans is default_spans else len(self.spans(text))

    def tail(self, text: str, n: int) -> str:
        s = self.spans(text)
        return text if len(s) <= n else (text[s[-n][0] :].strip() if n > 0 else "")

    def head(self, text: str, n: int) -> str:
        s = self.spans(text)
        return text if len(s) <= n else (text[: s[n - 1][1]].strip() if n > 0 else "")

    def split_hard(self, text: str, n: int) -> list[str]:
        """Windows of n tokens."""
        s = self.spans(text)
        out = [text[s[i][0] : s[min(i + n, len(s)) - 1][1]] for i in range(0, len(s), n)]
        return [x for x in out if x.strip()] or [text]

    def pack(self, parts: list[str], n: int, glue: str, oversize: Callable[[str, int], list[str]]) -> list[str]:
        """Greedy: neighbours share a chunk while their counts, and that of the glue between them, add up to n; a part that is too long is split on its own."""
        out, held, sum_, between = [], [], 0, self.count(glue)
        for part in parts:
            own = self.count(part)
            if held and sum_ + between + own > n or not held and own > n:
                out += [glue.join(held)] if held else []
                held, sum_ = [], 0
                if own > n:
                    out += oversize(part, n)
                    continue
            sum_ += own + (between if held else 0)
            held.append(part)
        return out + [glue.join(held)] if held else out

    def split_punctuation(self, text: str, n: int) -> list[str]:
        parts = [p for p in PUNCTUATION.split(text) if p.strip()]
        return self.split_hard(text, n) if len(parts) <= 1 else self.pack(parts, n, " ", self.split_hard)

    def split_lines(self, text: str, n: int) -> list[str]:
        parts = [p for p in (line.strip() for line in text.split("\n")) if p]
        return self.pack(parts, n, "\n", self.split_punctuation) or [text]

    def split_sentences(self, text: str, n: int) -> list[str]:
        return self.pack([p for p in self.sentences(text) if p.strip()], n, " ", self.split_punctuation) or [text]

    def split_rows(self, text: str, n: int) -> list[str]:
        """Table rows, the header on every piece; a row that is too long for one is a piece of its own, whole and under the header."""
        lines = text.splitlines()
        rule = next((i for i, line in enumerate(lines) if _ruled(line)), len(lines))
        top, rows = "\n".join(lines[: rule + 1]), [line.rstrip() for line in lines[rule + 1 :]]
        room = n - self.count(top)
        if not any(rows) or room <= 0:
            return self.split_lines(text, n)
        pieces = self.pack([r for r in rows if r], room, "\n", lambda row, _: [row])
        return [f"{top}\n{piece}" for piece in pieces]

    def split_block(self, text: str, kind: str, n: int) -> list[str]:
        return [text] if self.count(text) <= n else self.splitters.get(kind, self.split_lines)(text, n)

    def section_chunks(self, blocks: list[dict], n: int) -> list[tuple[list[str], str]]:
        """(breadcrumbs, body) of one section: its heading goes to the crumbs; a heading alone gives a chunk of its own text."""
        first = blocks[0]
        crumbs = list(first["breadcrumbs"]) + ([first["text"]] if first["type"] == "heading" else [])
        body = blocks[1:] if first["type"] == "heading" else blocks
        if not body:
            return [(crumbs, first["text"])]
        out: list[str] = []
        held: list[str] = []

        def flush():
            out.extend(self.pack(held, n, "\n\n", lambda x, _: [x]))
            held.clear()

        for b in body:
            if not b["text"].strip():
                continue
            if self.count(b["text"]) > n:
                flush()
                out += self.split_block(b["text"], b["type"], n)
            else:
                held.append(b["text"])
        flush()
        return [(crumbs, t) for t in out]

    def overlapped(self, raw: list[str], overlap: int) -> list[str]:
        """Each text after the end of the one before it."""
        return [self.tail(raw[i - 1], overlap) + "\n\n" + t if overlap > 0 and i else t for i, t in enumerate(raw)]

    def build_chunks(self, blocks: list[dict], max_tokens: int = 500, overlap: int = 100, model_max: int = MODEL_MAX) -> list[dict]:
        """Chunks of one document's blocks (with breadcrumbs), in order."""
        n, limit = budget(max_tokens, overlap, model_max)
        groups: list[list[dict]] = []
        for b in blocks:
            if b["type"] == "heading" or not groups:
                groups.append([])
            groups[-1].append(b)
        raw = [c for g in groups for c in self.section_chunks(g, n)]
        out = []
        for i, ((crumbs, own), text) in enumerate(zip(raw, self.overlapped([t for _, t in raw], overlap))):
            lead = "\n".join(crumbs[-3:]) + "\n\n"
            if self.count(lead + text) > limit:
                text = own
                if self.count(lead + text) > limit:
                    text = self.head(own, max(limit - self.count(lead), LEAST_BUDGET))
            out.append({"position": i, "breadcrumbs": crumbs, "text": text, "token_count": self.count(text), "embedding_input": lead + text})
        return out


DEFAULT = Chunker()


def chunks(blocks: DataFrame, id_col: str = "id", max_tokens: int = 500, overlap: int = 100, chunker: Chunker = DEFAULT, model_max: int = MODEL_MAX) -> DataFrame:
    """(id, position, breadcrumbs, text, token_count, embedding_input) of blocks with breadcrumbs."""

    run = slices.each(lambda rows: chunker.build_chunks(rows, max_tokens, overlap, model_max), T.ArrayType(CHUNK))
    per_doc = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("position", "type", "text", "breadcrumbs"))).alias("b"))
    return per_doc.select(id_col, F.explode(run("b")).alias("c")).select(id_col, "c.*")


def split_udf(kind: str, n: int, chunker: Chunker = DEFAULT):
    """Column function: pieces of a text of that block type with at most n tokens; kind `hard`: windows of n tokens."""

    split = (lambda t: chunker.split_hard(t, n)) if kind == "hard" else (lambda t: chunker.split_block(t, kind, n))
    return slices.each(lambda t: None if t is None else split(t), T.ArrayType(T.StringType()))


def count_udf(chunker: Chunker = DEFAULT):
    """Column function: the number of tokens; null for a null text."""

    return slices.each(lambda t: None if t is None else chunker.count(t), T.LongType())


def overlap_udf(overlap: int, chunker: Chunker = DEFAULT):
    """Column function: the texts of an array, each after the end of the one before it."""

    return slices.each(lambda a: None if a is None else chunker.overlapped(a, overlap), T.ArrayType(T.StringType()))
