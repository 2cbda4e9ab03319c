"""Benchmark decontamination (operator 8): rare n-gram seeds, then Smith-Waterman alignment.

1. Items and texts become lower-case words (ASCII punctuation parts words).  A seed is a pair of words of an item that stand
   side by side or have one word between them; it is met in a text where the two stand so, in either way.  So a seed survives
   one edit (word changed, added or left out) between its words.
2. One pass over all texts counts how often each seed occurs.  Each item keeps the places with its rarest seeds, as many as
   it takes for every copy at or above `threshold` to hold at least `hits` of them.
3. A second pass looks these up.  Hits of an item that lie as close as a copy is long form a site, with as many words around
   them as a copy can reach, and each site is aligned with its item (match 2, mismatch -1, gap -1), many sites in step.  The
   score is the best local alignment over that of the item with itself, 0 to 1; pairs at or above `threshold` are reported.

No copy escapes, however it is edited and however often it stands in the corpus.  An alignment of M matches and E edits
scores 2M - E.  Of its M - 1 pairs of neighbouring matches let c have at most one edit between them, so that they are seeds
met; the others have two or more, hence E >= 2 (M - 1 - c), and the score is at most 2c + 2.  A score of S so takes
c >= S / 2 - 1 places of the item.  Of the item's n - 1 places all but c - `hits` are looked up; `hits` of the copy's are
among them.  Its gaps number at most 2n - S, so its words lie within 3n - S words of the text.

Items of fewer than `whole_words` words are found where all their words stand in order, since so few words with an edit are
anywhere.  Items are broadcast in chunks of at most `chunk_bytes`; more of them mean more passes, never a larger broadcast.

Defined cases: null texts and items, and items without words, match nothing; repeated rows of a text give one row for each
item; a null doc_id is reported as null; items with equal texts are each reported; empty tables give no rows; other columns
are ignored, whatever they are called; a text of any length is looked through whole, at about 30 times its size in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import PUNCTUATED, U64, lower_ascii, mix, read_documents, slices, text_buffer, word_hashes, words_of

#: Words of sites that are aligned at a time.
ALIGNED = 200_000


def hashed_words(data: np.ndarray, offsets: np.ndarray):
    """(word hashes, words of each row)."""
    data = lower_ascii(data)
    start, end, row = words_of(data, offsets, PUNCTUATED)
    return word_hashes(data, start, end), np.bincount(row, minlength=len(offsets) - 1)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on (the last places are not valid)."""
    with np.errstate(over="ignore"):
        g = np.full(len(h), width, U64)
        for k in range(width):
            g[: len(h) - k] = mix(g[: len(h) - k] * U64(0x100000001B3) + h[k:])
    return g


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    h, count = hashed_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return np.split(h, np.cumsum(count)[:-1]) if len(raw) else []


def pairs(h: np.ndarray, count: np.ndarray):
    """(place of the first word, hash) of the words of each row side by side, then of those with one word between them."""
    left = np.repeat(np.cumsum(count), count) - np.arange(len(h))
    with np.errstate(over="ignore"):
        for apart in (1, 2):
            at = np.flatnonzero(left > apart)
            yield at, mix(h[at] * U64(0x100000001B3) + h[at + apart])


class Table:
    """Sorted hashes and a filter before them."""

    def __init__(self, hashes: np.ndarray):
        self.hash = hashes
        bits = min(26, max(20, 3 + len(hashes).bit_length()))
        self.shift = U64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(hashes >> self.shift).astype(np.int64)] = True

    def find(self, g: np.ndarray):
        """(index in g, index here) of all equal hashes."""
        p = np.flatnonzero(self.filter[(g >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, g[p], "left"), np.searchsorted(self.hash, g[p], "right")
        n = hi - lo
        return np.repeat(p, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass(frozen=True)
class Rule:
    """What a copy of an item of n words must have; n may be an array."""

    threshold: float
    hits: int
    whole_words: int

    def least(self, n):
        """The least score at the threshold, which is compared at six decimals."""
        return np.ceil(2 * n * (self.threshold - 5e-7)).astype(np.int64)

    def seeded(self, n):
        """Whether an item is found by seeds; others must stand whole."""
        return (n >= self.whole_words) & (self.least(n) > 2)

    def need(self, n):
        return np.minimum(self.hits, self._places(n))

    def looked_up(self, n):
        """Number of places to look up."""
        return n - 1 - self._places(n) + self.need(n)

    def gaps(self, n):
        return 2 * n - self.least(n)

    def _places(self, n):
        return (self.least(n) + 1) // 2 - 1


class Items:
    """The words of a chunk of items, and the places of them that are looked up."""

    def __init__(self, texts: list[str | None], rule: Rule):
        self.words, self.rule = item_words(texts), rule
        self.length = np.array([len(w) for w in self.words], np.int64)

    def seeds(self, only: np.ndarray | None = None):
        """(hash, item, place) of each seed of the items (of those named)."""
        seeded = np.flatnonzero(self.rule.seeded(self.length))
        seeded = seeded if only is None else seeded[np.isin(seeded, only)]
        if not len(seeded):
            return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
        size = self.length[seeded]
        start = np.cumsum(size) - size
        at, g = (np.concatenate(x) for x in zip(*pairs(np.concatenate([self.words[k] for k in seeded.tolist()]), size)))
        k = np.searchsorted(start, at, "right") - 1
        return g, seeded[k], at - start[k]

    def whole(self):
        """(words, sorted hashes, items) of the items that must stand whole, by their number of words."""
        short = np.flatnonzero((self.length > 0) & ~self.rule.seeded(self.length))
        for n in np.unique(self.length[short]).tolist():
            k = short[self.length[short] == n]
            g = np.array([grams(self.words[x], n)[0] for x in k.tolist()], U64)
            order = np.argsort(g, kind="stable")
            yield n, Table(g[order]), k[order]


def runs(row: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, length: np.ndarray, rule: Rule):
    """(row, item, first and last diagonal) of each group of hits that may be a copy; at: place in the row."""
    hit = np.unique(np.stack((row, item, at, place)), axis=1)
    row, item, at, place = hit
    n, size = length[item], len(at)
    reach = n + rule.gaps(n)
    last = np.arange(size) + rule.need(n) - 1
    end = np.minimum(last, size - 1)
    full = (last < size) & (row[end] == row) & (item[end] == item) & (at[end] - at < reach)
    step = np.bincount(np.flatnonzero(full), minlength=size + 1) - np.bincount(last[full] + 1, minlength=size + 1)
    live = np.flatnonzero(np.cumsum(step[:size]) > 0)
    row, item, at, place, reach = row[live], item[live], at[live], place[live], reach[live]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] >= reach[1:])
    first = np.flatnonzero(new)
    if not len(first):
        return row, item, at, at
    return row[first], item[first], np.minimum.reduceat(at - place, first), np.maximum.reduceat(at - place, first)


def align(items: list[np.ndarray], sites: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1):
    """(best local alignment score, site word after its end) of each pair, all pairs of a batch in step."""
    n = len(items)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = max(map(len, items)), max(map(len, sites))
    x, y = np.zeros((a, n), U64), np.ones((n, b), U64)  # paddings differ, so they match nothing
    y_in = np.zeros((n, b), bool)
    for k, (i, s) in enumerate(zip(items, sites)):
        x[: len(i), k] = i
        y[k, : len(s)] = s
        y_in[k, : len(s)] = True
    steps = np.arange(b) * -gap
    row = np.zeros((n, b + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    length = np.array([len(i) for i in items])
    for i in range(a):
        score = np.where((y == x[i][:, None]) & y_in, match, mismatch).astype(np.int32)
        new = np.maximum(row[:, :-1] + score, row[:, 1:] + gap)
        np.maximum(new, 0, out=new)
        # a gap in the item: the best start to the left, less its distance
        new = (np.maximum.accumulate(new + steps, axis=1) - steps).astype(np.int32)
        new[(i >= length)] = 0
        row[:, 1:] = new
        at = new.argmax(axis=1)
        top = new[np.arange(n), at]
        better = top > best
        best = np.where(better, top, best)
        end = np.where(better, at + 1, end)
    return best, end


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    hits: int = 3,
    whole_words: int = 8,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, score, end_word, item_words) of each text and item that it holds a copy of."""
    spark = docs.sparkSession
    rule = Rule(threshold, hits, whole_words)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    out = None
    for c in range(chunks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).distinct().orderBy("item_id", "text").collect()
        part = _chunk(d, [r["item_id"] for r in rows], spark.sparkContext.broadcast([r["text"] for r in rows]), rule)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", F.col("end_word").alias("e"), "item_words")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.score").alias("score"), F.col("m.e").alias("end_word"), F.col("m.item_words").alias("item_words"))


def _texts(batches):
    """(ids, word hashes, words of each row) of about a megabyte of texts at a time."""
    for b in batches:
        data, offsets = text_buffer(b.column(1))
        ids = b.column(0)
        for i, j in slices(offsets, 1 << 20):
            h, count = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(h):
                yield ids.slice(i, j - i), h, count


def rare_places(d: DataFrame, n_items: int, sent, rule: Rule) -> DataFrame:
    """(item, place) to look up: of each item those whose seeds occur least often in the texts."""

    def count(batches):
        seeds = Table(np.unique(Items(sent.value, rule).seeds()[0]))
        n = np.zeros(len(seeds.hash), np.int64)
        for _, h, size in _texts(batches):
            for _, g in pairs(h, size):
                seed, times = np.unique(seeds.find(g)[1], return_counts=True)
                n[seed] += times
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seeds.hash[met].view(np.int64)), pa.array(n[met])], names=["seed", "n"])

    def owned(batches):
        items = Items(sent.value, rule)
        for b in batches:
            g, item, place = items.seeds(b.column(0).to_numpy())
            cols = [g.view(np.int64), item, place, rule.looked_up(items.length[item])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["seed", "item", "place", "places"])

    counted = d.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    seeds = d.sparkSession.range(n_items).mapInArrow(owned, "seed long, item long, place long, places long")
    places = seeds.join(counted, "seed", "left").groupBy("item", "place", "places").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("n", "place"))
    return places.withColumn("rank", rank).filter("rank <= places").select("item", "place")


def _chunk(d: DataFrame, ids: list, sent, rule: Rule) -> DataFrame:
    context = d.sparkSession.sparkContext
    chosen = rare_places(d, len(ids), sent, rule).toArrow()  # at most one row for each word of the chunk
    rare = context.broadcast((chosen["item"].to_numpy(), chosen["place"].to_numpy()))
    names = context.broadcast(ids)

    def scan(batches):
        items = Items(sent.value, rule)
        g, item, place = items.seeds()
        wide = int(items.length.max(initial=0)) + 1
        looked_up = np.isin(item * wide + place, rare.value[0] * wide + rare.value[1])
        order = np.flatnonzero(looked_up)[np.argsort(g[looked_up], kind="stable")]
        seeds, item, place = Table(g[order]), item[order], place[order]
        whole = list(items.whole())
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for doc, h, count in _texts(batches):
            first = np.cumsum(count) - count
            found = []
            if len(order):
                at, s = (np.concatenate(x) for x in zip(*[(p[i], s) for p, g in pairs(h, count) for i, s in [seeds.find(g)]]))
                row = np.searchsorted(first, at, "right") - 1
                found += aligned(h, first, count, *runs(row, item[s], at - first[row], place[s], items.length, rule), items)
            for n, table, k in whole:
                at = np.flatnonzero(np.repeat(first + count, count) - np.arange(len(h)) >= n)
                i, s = table.find(grams(h, n)[at])
                row = np.searchsorted(first, at[i], "right") - 1
                found += zip(row.tolist(), k[s].tolist(), [1.0] * len(s), (at[i] - first[row] + n).tolist())
            if found:
                row, k, share, end = zip(*found)
                cols = [[names.value[x] for x in k], share, end, items.length[list(k)].tolist()]
                cols = [doc.take(pa.array(row)), *[pa.array(x, t) for x, t in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "end_word", "item_words"])

    return d.mapInArrow(scan, "doc_id long, item_id long, score double, end_word long, item_words long")


def aligned(h: np.ndarray, first: np.ndarray, count: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, items: Items):
    """[(row, item, score, end word)] of the sites that hold a copy."""
    n = items.length[item]
    room = items.rule.gaps(n)
    lo, hi = np.maximum(low - room, 0), np.minimum(high + n + room, count[row])
    order = np.argsort(hi - lo, kind="stable")
    out, u = [], 0
    while u < len(order):
        v = u + 1  # as many sites as fit a bounded table
        while v < len(order) and (v - u + 1) * (hi - lo)[order[v]] <= ALIGNED:
            v += 1
        k = order[u:v]
        best, end = align([items.words[x] for x in item[k].tolist()], [h[a:b] for a, b in zip((first[row[k]] + lo[k]).tolist(), (first[row[k]] + hi[k]).tolist())])
        share = np.round(best / (2.0 * n[k]), 6)
        copy = share >= items.rule.threshold
        k = k[copy]
        out += zip(row[k].tolist(), item[k].tolist(), share[copy].tolist(), (lo[k] + end[copy]).tolist())
        u = v
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
