"""Pieces shared by the training-data operators: durable intermediate tables and vectorised word access."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a folder of our own where that is unset and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying its text; a null is an empty text."""
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = str(column.type).startswith("large")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.empty(0, np.uint8)
    if column.null_count:  # the value slot of a null may hold bytes
        valid = np.asarray(column.is_valid())
        keep = np.where(valid, np.diff(offsets), 0)
        data = np.concatenate([data[a : a + k] for a, k in zip(offsets[:-1], keep)] or [data[:0]])
        offsets = np.concatenate(([0], np.cumsum(keep)))
        return data, offsets
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows that hold about `most` bytes; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


#: Bytes that part words where punctuation does not count: ASCII other than letters and digits.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = [not chr(i).isalnum() for i in range(128)]


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run without ASCII white space (or other bytes); runs end with their row."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e
    word = ~apart[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
#: Constants that set apart the two lanes of a 128-bit name.
LANES = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each word data[start:end]: its bytes are mixed in eight at a time; very long words by BLAKE2b."""
    if not len(start):
        return np.empty(0, U64)
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * LANES[lane] + LANES[1 - lane])
        h = mix((h ^ (eight[start] & _HEAD[np.minimum(size, 8)])) * LANES[lane])
        left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        done = 8
        while len(left):
            v = eight[start[left] + done] & _HEAD[np.minimum(size[left] - done, 8)]
            h[left] = mix((h[left] ^ mix(v + LANES[lane])) * LANES[1 - lane])
            done += 8
            left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return h


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word data[start:end]: equal numbers mean equal bytes, here and now (no hash decides)."""
    if not len(start):
        return np.empty(0, np.int64)
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers: equal numbers mean equal pairs."""
    base = np.int64(int(right.max(initial=0)) + 1)
    return np.unique(left * base + right, return_inverse=True)[1].astype(np.int64)


def exact_spans(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for the `length` symbols from each place on, by naming pairs of names: equal numbers mean equal symbols."""
    name, width = ids, 1
    while width < length:
        step = min(width, length - width)
        name = pair_ids(name[: len(name) - step], name[step:])
        width += step
    return name


class Spans:
    """128-bit names, in two lanes, of stretches of symbols given by a 64-bit hash for each lane.

    Names of blocks of a power of two symbols are made by doubling; a stretch is named by the blocks that tile it, the last
    of which may overlap the one before.
    """

    def __init__(self, lanes: list[np.ndarray], least: int):
        self.block = 1 << (least.bit_length() - 1)
        self.names = []
        for k, h in enumerate(lanes):
            width = 1
            with np.errstate(over="ignore"):
                while width < self.block:
                    h = mix(h[: max(0, len(h) - width)] * LANES[k] + mix(h[width:] + LANES[1 - k]))
                    width *= 2
            self.names.append(h)

    @classmethod
    def tiled(cls, names: list[np.ndarray], block: int) -> "Spans":
        """From names of the blocks at all places."""
        out = cls.__new__(cls)
        out.block, out.names = block, names
        return out

    def name(self, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Names of the stretches; none may be shorter than `least`."""
        b, out = self.block, []
        for k, names in enumerate(self.names):
            with np.errstate(over="ignore"):
                h = mix(names[start] + length.astype(U64) * LANES[k]) if len(start) else np.empty(0, U64)
                left, done = np.flatnonzero(length > b), b
                while len(left):
                    at = start[left] + np.minimum(done, length[left] - b)
                    h[left] = mix(h[left] * LANES[1 - k] + mix(names[at] ^ LANES[k]))
                    done += b
                    left = left[length[left] > done]
            out.append(h)
        return out
