"""LM scoring (operator 4): a causal self-attention model over subword ids, beside an add-one unigram over words.

Words of all training texts are counted in full: counts are summed by word hash, pre-aggregated by Arrow batch.  The
commonest words, at most `frequent`, are broadcast (16 bytes each); a text's other words are joined to the counts by hash, so no
count is cut off and the broadcast has a fixed bound.

Each text is encoded once.  Over all ids of all training texts one Spark sum, pre-aggregated by task, counts the pairs of ids in a
row; sums over that table give the model (see `attention`) its rows, classes and shares.  The table grows with the corpus; the
commonest pairs, at most `most_pairs`, go into the model itself.  The attention's weights are learned from every id of every training
text: each task goes once over its texts, from weights that all have in common, and the mean of what the tasks find, each with the
weight of its ids, is the model's.  The common weights that this begins with are fitted on pieces of `piece` ids chosen by hash from
anywhere in the training texts, `sample_rows` pieces' worth, and more as the square root of the corpus where that has over
`grow_from` ids.  Scoring covers whole texts; overlapping windows of 24 ids score 16 new ids each.

Defined cases: a null or empty text is one end token; a null doc_id is scored, is not held out and is not learned from;
without training texts N is 0 and the base is that of V = 0; repeated rows are each scored; an empty table gives no rows;
other columns are ignored.  A text of any length is scored whole, some windows at a time; its ids are one row.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import Model
from .common import U64, lower_ascii, materialise, mix, read_documents, slices, text_buffer, word_hashes, words_of
from .language import fold
from .subwords import subwords

RAW = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"


def _words(data, offsets):
    data = lower_ascii(data)
    start, end, row = words_of(data, offsets)
    return word_hashes(data, start, end), row


def word_counts(train: DataFrame) -> DataFrame:
    """(w, c) of every word of train(text)."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(0))
            parts = [_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] for i, j in slices(offsets, 1 << 20)]
            if parts:
                w, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    return train.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def encoded(d: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """d(doc_id, text, held_out) with the ids of each text, as bytes of numbers as wide as the vocabulary needs."""

    def run(batches):
        table = subwords(tokenizer_path)
        kind = id_type(table)
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for i, j in slices(offsets, 1 << 22):
                part = b.slice(i, j - i)
                ids, at = table.encode_all(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = ids.astype(kind)
                column = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=["doc_id", "text", "held_out", "ids"])

    return d.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, text string, held_out boolean, ids binary")


def id_type(table) -> str:
    return "<u2" if table.size <= 1 << 16 else "<u4"


def _texts(column, kind: str, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each between two marks; how many each has) of a column of ids."""
    ids = [np.frombuffer(x, kind) for x in column.to_pylist()]
    end = np.array([mark], kind)
    flat = np.concatenate([x for i in ids for x in (end, i, end)]) if ids else np.empty(0, kind)
    return flat.astype(np.int64), np.array([len(i) + 2 for i in ids], np.int64)


def count_pairs(coded: DataFrame, vocabulary: int, kind: str, mark: int, held: int = 1 << 21) -> DataFrame:
    """(key, c): how often an id follows another in the texts of coded(ids); key is the first times `vocabulary` plus the second."""

    def merged(parts):
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts[order], first)

    def run(batches):
        parts, n = [], 0
        for b in batches:
            column = b.column(0)
            for i, j in slices(text_buffer(column)[1], 1 << 20):
                flat, sizes = _texts(column[i:j], kind, mark)
                key = np.delete(flat[:-1] * vocabulary + flat[1:], np.cumsum(sizes)[:-1] - 1)
                if not len(key):
                    continue
                parts.append(np.unique(key.astype(np.uint32) if vocabulary <= 1 << 16 else key, return_counts=True))
                n += len(parts[-1][0])
                if n > held:
                    parts = [merged(parts)]
                    n = len(parts[0][0])
                    if 2 * n > held:  # few repeats: memory stays bounded
                        yield batch(*parts.pop())
                        n = 0
        if parts:
            yield batch(*merged(parts))

    def batch(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "c"])

    return coded.select("ids").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def tally(pairs: DataFrame, size: int, vocabulary: int, places) -> np.ndarray:
    """Sums of c over pairs(key, c) at places(ids, following ids), numbers under size."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            x, y = np.divmod(b.column(0).to_numpy(), vocabulary)
            own, at = places(x, y)
            np.add.at(total, at, b.column(1).to_numpy()[own])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "c"])

    got = pairs.select("key", "c").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("at").to_numpy()] = got.column("c").to_numpy()
    return out


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(..., c) with c of some power of two or more: the smallest that leaves at most `most` rows."""
    steps = counts.agg(*[F.count_if(F.col("c") >= (1 << k)).alias(str(k)) for k in range(62)]).first()
    least = next((1 << k for k in range(62) if (steps[str(k)] or 0) <= most), 1 << 62)
    return counts.filter(F.col("c") >= least)


def sample(coded: DataFrame, share: float, most: int, piece: int, kind: str, mark: int) -> list[np.ndarray]:
    """About a share of all pieces, at most `most`: each holds the id before it and up to `piece` ids, wherever in a text."""
    below = int(min(1.0, share) * (1 << 32))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                flat, _ = _texts(b.column(1)[i : i + 1], kind, mark)
                k = np.arange(-(-(len(flat) - 1) // piece), dtype=U64)
                h = mix(mix(np.full(len(k), b.column(0)[i].as_py(), np.int64).view(U64)) + k) >> U64(32)
                for x in np.flatnonzero(h < U64(below)).tolist():
                    cut = flat[x * piece : (x + 1) * piece + 1].astype(kind).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(h[x])]), pa.array([cut], pa.binary())], names=["h", "cut"])

    got = coded.select("doc_id", "ids").mapInArrow(run, "h long, cut binary").orderBy("h", "cut").limit(most).collect()
    return [np.frombuffer(r["cut"], kind).astype(np.int64) for r in got]


#: Steps of a weight's change, and of its mean: sums are of whole numbers, so that their order does not matter.
FINE = 1 << 16


def pass_over(coded: DataFrame, model: Model, p: dict[str, np.ndarray], kind: str, mark: int) -> dict[str, np.ndarray]:
    """The mean of the weights that the tasks find from p on, each over all its texts of coded(ids)."""
    sent = coded.sparkSession.sparkContext.broadcast((pickle.dumps(model), p))

    def run(batches):
        raw, start = sent.value

        def parts():
            for b in batches:
                for i, j in slices(text_buffer(b.column(0))[1], 1 << 18):
                    yield _texts(b.column(0)[i:j], kind, mark)

        after, seen = pickle.loads(raw).goes_on(start, parts())
        change = np.concatenate([np.rint((after[k].astype(np.float64) - start[k]) * FINE).ravel() for k in start]).astype(np.int64) * seen
        at = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(change[at], seen))], names=["at", "x"])

    # sums of changes may pass the range of long where a corpus is very large, sums of their halves do not
    halves = [F.sum(F.shiftright("x", 32)).alias("high"), F.sum(F.col("x").bitwiseAND((1 << 32) - 1)).alias("low")]
    got = coded.select("ids").mapInArrow(run, "at long, x long").groupBy("at").agg(*halves).toArrow()
    at, x = got.column("at").to_numpy(), got.column("high").to_numpy() * 2.0**32 + got.column("low").to_numpy()
    change = np.zeros(sum(w.size for w in p.values()))
    seen = float(x[at < 0].sum())
    change[at[at >= 0]] = x[at >= 0] / (FINE * max(1.0, seen))
    ends = np.cumsum([w.size for w in p.values()])
    return {k: (w + c.reshape(w.shape)).astype(w.dtype) for (k, w), c in zip(p.items(), np.split(change, ends[:-1]))}


def learn(
    coded: DataFrame, vocabulary: int, kind: str, *, sample_rows: int = 6000, piece: int = 512, grow_from: int = 1 << 27, most_pairs: int = 1 << 18
) -> Model:
    """The model of all texts of coded(doc_id, ids)."""
    mark = vocabulary - 1
    model = Model(vocabulary)
    pairs = materialise(count_pairs(coded, vocabulary, kind, mark), "pairs")
    count = tally(pairs, vocabulary, vocabulary, lambda x, y: (slice(None), y))
    ends = int(count[mark])
    count[mark] += ends  # each text's first mark follows nothing
    total = int(count.sum())
    model.rank(count)
    rows = len(model.own) * model.before
    model.group(count, tally(pairs, rows, vocabulary, model.pairs_by_row).reshape(-1, model.before))
    model.shares(count, tally(pairs, model.classes * vocabulary, vocabulary, model.pairs_by_class).reshape(model.classes, -1))
    common = commonest(pairs, most_pairs).toArrow()
    model.pairs(*np.divmod(common.column("key").to_numpy(), vocabulary), common.column("c").to_numpy())
    budget = sample_rows * piece * max(1.0, total / grow_from) ** 0.5
    share = budget / max(1, total)
    most = int(2 * share * (total / piece + ends)) + 64
    p = model.weights(sample(coded, share, most, piece, kind, mark))
    model._freeze(pass_over(coded, model, p, kind, mark))
    return model


_models: dict[int, Model] = {}


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out=None,
    tokenizer_path: str | None = None,
    frequent: int = 500_000,
    sample_rows: int = 6000,
    piece: int = 512,
    grow_from: int = 1 << 27,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; held_out: which rows not to learn from."""
    spark = docs.sparkSession
    out_ = F.lit(False) if held_out is None else held_out
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(out_, F.lit(False)).alias("held_out"))
    train = d.filter("NOT held_out AND doc_id IS NOT NULL")
    counts = materialise(word_counts(train), "words")
    ends = train.count()
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = total + ends, distinct + (ends > 0)
    top = commonest(counts, frequent).toArrow()
    w, c = top.column("w").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(w)
    table = subwords(tokenizer_path)
    mark = table.size - 1
    kind = id_type(table)
    coded = materialise(encoded(d, tokenizer_path), "ids")
    model = learn(coded.filter("NOT held_out AND doc_id IS NOT NULL"), table.size, kind, sample_rows=sample_rows, piece=piece, grow_from=grow_from)
    sent = spark.sparkContext.broadcast((w[order], c[order], ends, pickle.dumps(model)))
    floor = n + v + 1

    def run(batches):
        from pyspark import TaskContext

        words, times, ends, raw = sent.value
        key = hash(raw)
        if key not in _models:
            _models.clear()
            _models[key] = pickle.loads(raw)
        model = _models[key]
        log = np.log10((times + 1) / floor)
        last = float(np.log10((ends + 1) / floor))
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for i, j in slices(offsets, 1 << 18):
                h, row = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = h.view(np.int64)
                order = np.argsort(h)  # near words are looked up one after the other
                h, row = h[order], row[order]
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                hit = words[at] == h if len(words) else np.zeros(len(h), bool)
                m = j - i
                base = np.bincount(row[hit], log[at[hit]], minlength=m) + last if len(words) else np.full(m, last)
                known = np.bincount(row[hit], minlength=m) + (ends > 0)
                size = np.bincount(row, minlength=m) + 1
                own, pair = row[~hit], h[~hit]
                order = np.lexsort((pair, own))
                own, pair = own[order], pair[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (pair[1:] != pair[:-1])
                first = np.flatnonzero(new)
                repeat = np.diff(np.append(first, len(own))).astype(np.int32)
                border = np.concatenate(([0], np.cumsum(np.bincount(own[first], minlength=m)))).astype(np.int32)
                flat, sizes = _texts(b.column(3)[i:j], kind, mark)
                lists = [pa.ListArray.from_arrays(pa.array(border), pa.array(x)) for x in (pair[first], repeat)]
                cols = [pa.array(np.arange(rid, rid + m)), b.column(0)[i:j], b.column(2)[i:j], pa.array(size), pa.array(known), pa.array(base), pa.array(model.score(flat, sizes)), *lists]
                rid += m
                yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"])

    made = materialise(coded.mapInArrow(run, RAW), "scored")
    rare = made.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("w"), F.col("x.times").alias("k"))
    c = F.coalesce(F.col("c"), F.lit(0))
    joined = rare.join(counts, "w", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(floor)))).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("found")
    )
    return made.drop("rare", "times").join(joined, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce(F.col("found"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more"), F.lit(0.0))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_documents(spark, sf_dir), held_out=fold(F.col("doc_id"), 7) == 2)
