"""Language identification (operator 1): cross-parsing entropy against suffix automata.

For each language a suffix automaton is built over labelled text.  A document is parsed greedily into phrases, each the
longest match of the automaton from where the last one ended; with n symbols of reference text, phrases * log2(n) / length
estimates the bits a symbol costs in that language (the cross-parsing estimator of relative entropy).  The language with
the fewest bits wins; ties go to the first in alphabetical order.

Learning takes a bounded sample: at most `rows_per_language` rows with the smallest id hashes, `chars_per_row` characters of
each and `symbols_per_language` symbols in all (less where there are many languages, `total_symbols` at most together).
Only that sample reaches the driver, and workers build the automata from its broadcast.  Everything else is one pass over
whole texts without a shuffle.  Texts are read in blocks of `block` symbols, in step with one another: a state and a symbol
look up the next state and the phrases that ended, in one table.  A phrase ends with its block, the same for all languages.

Symbols are lower-case letters; anything between letters is one space.  The commonest letters of all samples have a symbol of
their own; any other letter of the samples is spelt in symbols of its own kind, a fixed number of them (two for up to 256 such
letters, three for up to 4096, and so on), so letters of every script stay apart while the tables stay narrow.  A letter that no sample
holds is one symbol which matches nothing.

Defined cases: a null text or one without letters is `und` with score 0; without any labelled row every text is `und`; a
null lang is not learned from; a null doc_id is scored, is not held out and is not learned from; repeated rows are each
scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read_documents, slices, text_buffer

SCHEMA = "doc_id long, lang_pred string, score double, bits double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
UND = "und"


def fold(id_col, divisor: int):
    """crc32 of the id as text, modulo divisor."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def suffix_automaton(codes) -> list[dict]:
    """Transitions of the smallest automaton that reads every substring of codes; state 0 is the root."""
    to, link, size = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


def parse_table(to: list[dict], k: int, base: int) -> np.ndarray:
    """Flat table of a greedy parse: entry [state * k + symbol] holds (place of the next state) * 4 + phrases that ended.

    The last symbol is padding: it changes nothing.
    """
    n = len(to)
    state = np.full((n, k), -1, np.int64)
    for s, row in enumerate(to):
        for c, t in row.items():
            state[s, c] = t
    root = state[0]
    missing = state < 0
    ended = np.where(missing, np.where(root < 0, 2, 1), 0)
    ended[0] = root < 0
    state = np.where(missing, np.maximum(root, 0), state)
    state[:, k - 1], ended[:, k - 1] = np.arange(n), 0
    return ((base + state * k) * 4 + ended).astype(np.int64 if (base + n * k) * 4 >= 2**31 else np.int32).ravel()


class Parser:
    """Automata of all languages behind one table."""

    def __init__(self, samples: dict[str, str], alphabet: int = 48, block: int = 512):
        self.langs = sorted(samples)
        self.block = block
        seen = Counter(c for s in samples.values() for c in s.lower() if c.isalpha())
        ranked = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        letters, others = ranked[: alphabet - 3], ranked[alphabet - 3 :]
        #: symbols of a letter that has none of its own: the first is one of 16, those after it are of 16 more
        self.width = 1
        while 16**self.width < len(others):
            self.width += 1
        self.width = max(2, self.width) if others else 1
        self.digit = len(letters) + 2
        #: 0 a space, 1 a letter of no sample, then the letters, then the symbols that spell other letters; the last is padding
        self.k = len(letters) + 3 + (32 if others else 0)
        code = np.zeros(0x110000, np.uint8)
        code[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for i, c in enumerate(letters):
            code[ord(c)] = i + 2
        self.spelt = np.zeros(0x110000 if others else 0, np.int32)
        for i, c in enumerate(others):
            code[ord(c)] = self.digit
            self.spelt[ord(c)] = i
        self.code = code
        tables, self.roots, self.weights, base = [], [], [], 0
        for lang in self.langs:
            symbols, _ = self.symbols([samples[lang]])
            to = suffix_automaton(symbols.tolist())
            tables.append(parse_table(to, self.k, base))
            self.roots.append(base)
            self.weights.append(math.log2(max(2, len(symbols))))
            base += len(to) * self.k
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)
        self.table = self.table.astype(np.int64) if base * 4 >= 2**31 else self.table
        self.weights = np.array(self.weights)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and how many each has."""
        texts = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        s = self.code[points]
        row = np.repeat(np.arange(len(texts)), sizes)
        before = np.zeros(len(s), bool)
        before[1:] = s[:-1] > 0
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        before[first] = False
        keep = (s > 0) | before  # one space after a letter, none at the start
        s, row = s[keep], row[keep]
        if len(self.spelt) and (spelt := s == self.digit).any():
            n = np.where(spelt, self.width, 1)
            at = (np.cumsum(n) - n)[spelt]
            number = self.spelt[points[keep][spelt]]
            s, row = np.repeat(s, n), np.repeat(row, n)
            for i in range(self.width):
                s[at + i] = self.digit + (16 if i else 0) + (number >> 4 * (self.width - 1 - i) & 15)
        return s, np.bincount(row, minlength=len(texts))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases[language, text], symbols[text])."""
        s, sizes = self.symbols(texts)
        block, g = self.block, len(self.langs)
        lanes = -(-sizes // block)
        total = int(lanes.sum())
        out = np.zeros((g, len(texts)), np.int64)
        if not total or not g:
            return out, sizes
        row = np.repeat(np.arange(len(texts)), sizes)
        within = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lane = (np.cumsum(lanes) - lanes)[row] + within // block
        grid = np.full((min(block, int(sizes.max())), total), self.k - 1, np.uint8)
        grid[within % block, lane] = s
        roots = np.array(self.roots, self.table.dtype)[:, None]
        state = np.repeat(roots, total, axis=1)
        ended = np.zeros((g, total), np.int32)
        for symbol in grid:
            v = self.table.take(state + symbol)
            ended += v & 3
            state = v >> 2
        ended += state != roots
        owner = np.repeat(np.arange(len(texts)), lanes)
        for i in range(g):
            out[i] = np.bincount(owner, ended[i], minlength=len(texts)).astype(np.int64)
        return out, sizes

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits a symbol) of each text."""
        found, sizes = self.phrases(texts)
        if not self.langs:
            return [(UND, 0.0, None)] * len(texts)
        bits = found * self.weights[:, None]
        out = []
        for i, n in enumerate(sizes.tolist()):
            if not n:
                out.append((UND, 0.0, None))
                continue
            b = bits[:, i]
            k = int(b.argmin())
            second = np.partition(b, 1)[1] if len(b) > 1 else math.inf
            out.append((self.langs[k], float(min(1.0, max(0.0, 1 - b[k] / second))), float(b[k] / n)))
        return out


def learn(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train=None,
    rows_per_language: int = 48,
    chars_per_row: int = 2500,
    symbols_per_language: int = 60_000,
    total_symbols: int = 600_000,
    most_languages: int = 1000,
) -> dict[str, str]:
    """A bounded sample of labelled text for each language; `train` is a filter for rows that may be learned from."""
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("l"), text.alias("t"), (F.lit(True) if train is None else train).alias("ok"))
    rows = rows.filter(F.col("ok") & F.col("id").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return {}
    h = F.xxhash64(F.col("id").cast("string"))
    # four times as many as asked for pass the first cut, so a window sees few rows of any language
    n = F.element_at(F.create_map(*[F.lit(x) for k in counts.items() for x in k]), F.col("l"))
    share = F.shiftright(h, 33).bitwiseAND((1 << 30) - 1) < F.lit(4.0 * rows_per_language * (1 << 30)) / n
    few = rows.filter(share).select("l", h.alias("h"), F.substring("t", 1, chars_per_row).alias("t"))
    best = few.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= rows_per_language)
    found: dict[str, list[str]] = {}
    for r in best.orderBy("l", "r").collect():
        found.setdefault(r["l"], []).append(r["t"])
    most = max(1, min(symbols_per_language, total_symbols // max(1, len(found))))
    return {k: " ".join(v)[:most] for k, v in found.items()}


_parsers: dict[int, Parser] = {}


def identify(docs: DataFrame, samples: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Language of every whole text.  extra: columns to carry along unchanged, in a struct `extra`."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(samples)
    keep = list(extra or [])
    # the text goes to the worker once; in a carried row it takes its place again
    place = keep.index(text_col) if text_col in keep and dict(docs.dtypes)[text_col] == "string" else None

    def run(batches):
        key = hash(tuple(sorted(sent.value.items())))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(sent.value)
        parser = _parsers[key]
        for whole in batches:
            for i, j in slices(text_buffer(whole.column(1))[1], 1 << 21):
                b = whole.slice(i, j - i)
                lang, score, bits = zip(*parser.predict([t or "" for t in b.column(1).to_pylist()]))
                own = [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
                if keep:
                    carried = b.column(2)
                    fields = [carried.field(k) for k in range(len(sent_along))]
                    if place is not None:
                        fields.insert(place, b.column(1))
                    own.append(pa.StructArray.from_arrays(fields, names=keep))
                yield pa.RecordBatch.from_arrays(own, names=[*_ARROW.names, "extra"][: len(own)])

    sent_along = [c for i, c in enumerate(keep) if i != place]
    carried = [F.struct(*(sent_along or [F.lit(True).alias("none")])).alias("extra")] if keep else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    schema = SCHEMA + (f", extra {docs.select(F.struct(*keep).alias('extra')).schema['extra'].dataType.simpleString()}" if keep else "")
    return d.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = fold(F.col("doc_id"), 5) == 0
    samples = learn(docs, train=~out)
    held = F.coalesce(out, F.lit(False)).alias("held_out")
    return identify(docs, samples).select("doc_id", held, "lang_pred", "score", "bits")
