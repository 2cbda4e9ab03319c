"""Sharding (operator 9): k-d tree partitioning by weighted medians, in DataFrame functions alone.  Law: `bytes`.

A node stands for a range of shards.  While it has more than one, it is split along its widest metadata dimension, at the
weighted quantile that gives each side bytes in proportion to its shards; the leaves are the shards.  All nodes of a level
are split together, and rows never move: a node is an expression over the row's coordinates.

Dimensions: bytes (logarithm), bytes a character, lines (logarithm), language and source.  Each is a number from 0 to 65535 between
the table's smallest and largest value; a name is placed between the first and the last in byte order.  Rows with equal texts have
one place: language and source are the smallest that any of them has.

A coordinate is a 63-bit key: 16 bits of the dimension, 31 bits of a hash of the text, 16 bits of a hash of the row; the
hashes part what a dimension cannot.  The weighted quantile is found by distributed radix descent: bytes are summed by
(node, next digit), pre-aggregated before the shuffle, the cell in which the target lies is descended into until the bytes of that
cell are within `tolerance` of the node's.  A group of equal texts is never parted, unless it is larger than `group_share` of
a shard: then its rows are dealt out, so that bytes stay near equal.  Where a group that stays whole makes the cut miss its goal by
more than `miss_share` of a shard, the node is cut along its next widest dimension, in which the group stands elsewhere; if all
of them miss, along the one that misses least.  The driver receives the sums of one digit, at most 1024 for each node and step.

slot: rows of a shard are numbered in salted subgroups of about `slot_group` rows, whose offsets are sums of their counts.

Defined cases: a null text has size 8 and crc 0, a null language or source comes before all others; without these columns their
dimension has no width; repeated rows are rows of their own; a null doc_id is kept; an empty table gives no rows; other columns
are ignored.  A text of any length is one row.  If there are fewer rows than shards, some shards stay empty.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import materialise, read_documents

#: The digits of a key, by the bits below each.
SHIFTS = (53, 43, 33, 24, 16, 8, 0)
BITS = 63
#: Bits of a key below which it tells rows of one text apart.
ROW_BITS = 16
MEASURES, NAMES = ("bytes", "density", "lines"), ("lang", "source")
DIMENSIONS = range(len(MEASURES) + len(NAMES))
#: A group of copies with more than this share of all rows is a hot one; there are at most 1 / HOT of them.
HOT = 1 / 512


def _place(column, low: str | None, high: str | None):
    """A name as a number that keeps byte order: the bytes after what the first and the last name share."""
    shared = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    number = lambda c: F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), shared + 1, 6)), 12, "0"), 16, 10).cast("double")
    return number(column), number(F.lit(low or "")), number(F.lit(high or ""))


def coordinates(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The narrow table that all steps read: no text.  v0, v1, ...: the dimensions; tail: the key's lower 47 bits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    raw = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        F.log2(size.cast("double")).alias("bytes"),
        (F.octet_length(text) / F.greatest(F.length(text), F.lit(1))).alias("density"),
        F.log2((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("double")).alias("lines"),
        name(lang_col).alias("lang"),
        name(source_col).alias("source"),
        F.monotonically_increasing_id().alias("rid"),
    )
    raw = materialise(raw, "metadata")
    # equal texts share their place
    group = ["g", "text_crc32", "size"]
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in (*MEASURES, *NAMES) for f in (F.min, F.max)]
    all_ = raw.agg(F.count("*").alias("rows"), *ends).first()
    copies = raw.groupBy(*group).agg(F.count("*").alias("n"), *[F.min(c).alias(f"g_{c}") for c in NAMES]).filter("n > 1")
    few = copies.filter(F.col("n") > max(64, all_["rows"] * HOT)).drop("n")
    rest = copies.filter(F.col("n") <= max(64, all_["rows"] * HOT)).drop("n")
    hot = raw.join(F.broadcast(few), group)
    cold = raw.join(F.broadcast(few), group, "left_anti").join(rest, group, "left")
    d = hot.unionByName(cold).withColumns({c: F.coalesce(f"g_{c}", c) for c in NAMES})
    values = [(F.col(c), F.lit(all_[f"min_{c}"]), F.lit(all_[f"max_{c}"])) for c in MEASURES]
    values += [_place(F.col(c), all_[f"min_{c}"], all_[f"max_{c}"]) for c in NAMES]
    scaled = [F.floor(F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)) * 65535).cast("long") for x, low, high in values]
    row = F.xxhash64("doc_id", "rid").bitwiseAND(65535)
    tail = F.shiftleft(F.col("g").bitwiseAND((1 << 31) - 1), ROW_BITS).bitwiseOR(row)
    d = d.select("doc_id", "size", "text_crc32", "rid", tail.alias("tail"), *[F.least(F.greatest(v, F.lit(0)), F.lit(65535)).cast("long").alias(f"v{k}") for k, v in enumerate(scaled)])
    return materialise(d, "shards")


def _key(dim: int):
    return F.shiftleft(F.col(f"v{dim}"), 47).bitwiseOR(F.col("tail"))


def _tree(splits: dict, leaf, n: int = 0):
    """leaf(node) of the node that a row belongs to.  splits: node -> (dimension, boundary); its children are 2n+1 and 2n+2."""
    if n not in splits:
        return leaf(n)
    dim, at = splits[n]
    return F.when(_key(dim) < F.lit(at), _tree(splits, leaf, 2 * n + 1)).otherwise(_tree(splits, leaf, 2 * n + 2))


def _node(n: int):
    return F.lit(n).cast("long")


def _descend(base: DataFrame, splits: dict, goals: dict, tolerance: float, group_bytes: float) -> dict:
    """(boundary, bytes by which a group that stays whole makes it miss) of each node: the key below which its bytes come closest to the goal.

    goals: node -> (dimension, bytes left of the cut, bytes of the node).
    """
    found, prefix, before = {}, dict.fromkeys(goals, 0), dict.fromkeys(goals, 0)
    for above, shift in zip((BITS, *SHIFTS), SHIFTS):
        left = {n: g for n, g in goals.items() if n not in found}
        if not left:
            break
        missing = F.lit(None).cast("long")
        key = _tree(splits, lambda n: _key(left[n][0]) if n in left else missing)
        start = _tree(splits, lambda n: F.lit(prefix[n]).cast("long") if n in left else missing)
        cells = base.select(_tree(splits, _node).alias("node"), key.alias("key"), start.alias("start"), "size")
        cells = cells.filter(F.shiftright("key", above) == F.col("start"))
        sums = cells.groupBy("node", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("bytes"))
        by_node: dict = {}
        for r in sums.collect():
            by_node.setdefault(r["node"], []).append((r["cell"], r["bytes"]))
        for n, own in by_node.items():
            low = before[n]
            for cell, size in sorted(own):
                if low + size >= goals[n][1]:
                    break
                low += size
            under, over = abs(low - goals[n][1]), abs(low + size - goals[n][1])
            whole = shift == ROW_BITS and size <= group_bytes
            if size <= tolerance * goals[n][2] or shift == 0 or whole:
                found[n] = min((cell + (over < under)) << shift, (1 << BITS) - 1), min(under, over) if whole else 0
            else:
                prefix[n], before[n] = cell, low
    return found


def _cuts(base: DataFrame, splits: dict, nodes: dict, tolerance: float, group_bytes: float, miss_bytes: float) -> dict:
    """node -> (dimension, boundary).  nodes: node -> (dimensions by falling width, bytes left of the cut, bytes of the node)."""
    best: dict = {}  # node -> (miss, turn, dimension, boundary)
    for turn in range(len(DIMENSIONS)):
        goals = {n: (dims[turn], goal, size) for n, (dims, goal, size) in nodes.items() if turn < len(dims) and (n not in best or best[n][0] > miss_bytes)}
        if not goals:
            break
        for n, (at, miss) in _descend(base, splits, goals, tolerance, group_bytes).items():
            best[n] = min(best.get(n, (miss, turn, goals[n][0], at)), (miss, turn, goals[n][0], at))
    return {n: cut[2:] for n, cut in best.items()}


def partition(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    shards: int = 24,
    tolerance: float = 0.0005,
    group_share: float = 1.0,
    miss_share: float = 0.025,
    slot_group: int = 10_000,
) -> DataFrame:
    """Shard and slot of every row; shards differ little in bytes."""
    base = coordinates(docs, id_col, text_col, lang_col, source_col)
    leaves, splits = {0: (0, shards)}, {}  # node -> (first shard, number of shards)
    rows = total = None
    while any(n > 1 for _, n in leaves.values()):
        wide = [n for n, (_, k) in leaves.items() if k > 1]
        at = base.select(_tree(splits, _node).alias("node"), "size", *[f"v{k}" for k in DIMENSIONS]).filter(F.col("node").isin(wide))
        stats = at.groupBy("node").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows"), *[(F.max(f"v{k}") - F.min(f"v{k}")).alias(f"w{k}") for k in DIMENSIONS]
        )
        got = {r["node"]: r for r in stats.collect()}
        if rows is None:
            rows, total = sum(r["rows"] for r in got.values()), sum(r["bytes"] for r in got.values())
        nodes = {}
        for n, r in got.items():
            dims = sorted(DIMENSIONS, key=lambda k, r=r: -r[f"w{k}"])
            dims = [k for k in dims if r[f"w{k}"]] or dims[:1]
            nodes[n] = (dims, r["bytes"] * (leaves[n][1] // 2) // leaves[n][1], r["bytes"])
        level = _cuts(base, splits, nodes, tolerance, group_share * total / shards, miss_share * total / shards)
        splits |= level
        for n in wide:
            first, k = leaves.pop(n)
            if n not in level:  # no rows
                leaves[n] = (first, 1)
                continue
            leaves[2 * n + 1], leaves[2 * n + 2] = (first, k // 2), (first + k // 2, k - k // 2)
    salts = max(1, (rows or base.count()) // (shards * slot_group) + 1)
    out = base.withColumn("shard", _tree(splits, lambda n: F.lit(leaves[n][0])).cast("int")).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"))
    counts = out.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "salt", (F.sum("n").over(W.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("offset"))
    within = F.row_number().over(W.partitionBy("shard", "salt").orderBy("rid"))
    return (
        out.withColumn("within", within)
        .join(offsets, ["shard", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition(read_documents(spark, sf_dir))
