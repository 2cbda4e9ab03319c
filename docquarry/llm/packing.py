"""Packing (operator 5): order-preserving dynamic programming over cut positions.

The documents of an input partition form one token stream in their order.  A sequence is a window of that stream of at
most `max_len` tokens; its end is one of the candidate cuts: document ends (free), sentence ends (`sentence_penalty`) and,
inside runs of more than `stride` tokens without either, every `stride`-th token (`inner_penalty`).  With c the position
of a cut and p its penalty,

    best[k] = p[k] + min over j with c[k] - c[j] <= max_len of best[j] + max_len - (c[k] - c[j])

is the least padding plus truncation penalties of a packing that ends at cut k.  The minimum runs over a sliding window,
so a monotone queue gives it in amortised constant time.  The stream is taken in blocks of `block_tokens`; the last
windows of a block go back to the stream, so only the last sequence of a partition is short.

No shuffle: a partition is packed by one task as it is read, and a task that runs again makes the same sequences.
sequence_id holds the partition in its high bits.

Defined cases: a null or empty text is its end id alone; rows may repeat (each is packed by itself); a null doc_id stays
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents
from .subwords import subwords

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
)
_ARROW = pa.schema(
    [(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")]
)


def best_cuts(at: np.ndarray, penalty: np.ndarray, max_len: int) -> list[int]:
    """Indices into `at` (ascending cut positions, the first 0) of the ends of the cheapest windows."""
    c, p = at.tolist(), penalty.tolist()
    n = len(c)
    best, back = [0.0] * n, [0] * n
    queue = deque([(0.0, 0)])  # (best[j] + c[j], j), ascending in both
    for k in range(1, n):
        ck = c[k]
        while ck - c[queue[0][1]] > max_len:
            queue.popleft()
        value, j = queue[0]
        back[k] = j
        best[k] = own = p[k] + value + max_len - ck
        own += ck
        while queue and queue[-1][0] >= own:  # of equal costs the later start wins
            queue.pop()
        queue.append((own, k))
    out, k = [], n - 1
    while k > 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def encode(text: str | None, table, tables, eos_id: int, stride: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(ids, candidate cuts within the document, whether each is a sentence end); the last cut is the document's end."""
    end = int(eos_id).to_bytes(4, "little")
    if not text:
        return end, np.array([1]), np.array([True])
    joined = table.encode(text) + end
    ids = np.frombuffer(joined, "<u4")
    ends, begins = tables
    at = np.flatnonzero(ends[ids[:-2]] & begins[ids[1:-1]]) + 1
    cuts = np.append(at, len(ids))
    start = np.concatenate(([0], at))
    inner = (cuts - start - 1) // stride
    if inner.any():  # every stride-th token of the longer gaps
        more = np.repeat(start, inner) + stride * (np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1)
        order = np.argsort(np.concatenate((cuts, more)), kind="stable")
        return joined, np.concatenate((cuts, more))[order], order < len(cuts)
    return joined, cuts, np.ones(len(cuts), bool)


class _Stream:
    """The part of a partition's token stream that is not yet packed."""

    def __init__(self, partition: int, max_len: int, sentence_penalty: float, inner_penalty: float):
        self.docs: list[tuple] = []  # (doc_id, tokens already packed, ids, cuts, sentence)
        self.tokens = 0
        self.next = partition << 32
        self.max_len, self.penalties = max_len, (inner_penalty, sentence_penalty)

    def add(self, doc_id, ids: bytes, cuts, sentence) -> None:
        self.docs.append((doc_id, 0, ids, cuts, sentence))
        self.tokens += len(ids) // 4

    def pack(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        at, penalty, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, done, ids, cuts, sentence in self.docs:
            left = cuts > done
            own = cuts[left] - done + base
            cost = np.where(sentence[left], self.penalties[1], self.penalties[0])
            cost[-1] = 0.0
            at.append(own)
            penalty.append(cost)
            base = int(own[-1])
        at, penalty = np.concatenate(at), np.concatenate(penalty)
        ends = [int(at[k]) for k in best_cuts(at, penalty, self.max_len)]
        if not final:
            ends = ends[:-2]  # the last windows may do better with what follows
        rows, k, begin = [], 0, 0
        stop = 0
        keep = []
        ends.append(None)
        for doc_id, done, ids, cuts, sentence in self.docs:
            n = len(ids) // 4
            while done < n and ends[k] is not None:
                take = min(n - done, ends[k] - stop)
                length = ends[k] - begin
                padded = 1 << (length - 1).bit_length() if final and ends[k + 1] is None else self.max_len
                crc = zlib.crc32(ids[4 * done : 4 * (done + take)])
                rows.append((doc_id, done, take, crc, n, self.next, stop - begin, padded))
                done += take
                stop += take
                if stop == ends[k]:
                    begin, k = stop, k + 1
                    self.next += 1
            if done < n:
                keep.append((doc_id, done, ids, cuts, sentence))
        self.docs = keep
        self.tokens = sum(len(d[2]) // 4 - d[1] for d in keep)
        return rows


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 2048,
    eos_id: int = 1,
    tokenizer_path: str | None = None,
    sentence_penalty: float = 2.0,
    inner_penalty: float = 6.0,
    stride: int = 32,
    block_tokens: int = 1 << 19,
) -> DataFrame:
    """Pieces of every document in sequences of at most max_len tokens (columns of SCHEMA)."""

    def run(batches):
        from pyspark import TaskContext

        table = subwords(tokenizer_path)
        tables = table.sentence_tables()
        stream = _Stream(TaskContext.get().partitionId(), max_len, sentence_penalty, inner_penalty)
        stride_ = max(1, min(stride, max_len // 64))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stream.add(doc_id, *encode(text, table, tables, eos_id, stride_))
                if stream.tokens >= block_tokens and (rows := stream.pack(False)):
                    yield batch(rows)
        if rows := stream.pack(True):
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir))
