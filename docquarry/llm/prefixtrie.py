"""Conversation prefix trie: digest-keyed parent edges, and sums over subtrees by pointer jumping.

Plan.  A turn is a 256-bit digest of its role and text and the number of its text's bytes; texts go no further than the scan.  Turns are numbered by one
range partitioning: rows are numbered within a partition, and partitions of one conversation are added up from a small table of counts, so that a conversation of any
length is dealt over many tasks.  A prefix is named by digests of groups of GROUP turns: a name is the digest of the name before its group and of the group's
turns so far; the names before the groups come from the same step over one row for each group, which ends after log32(length) steps.  The
nodes are the different names, with their parents' names as edges.

Leaves and savings are summed over subtrees by doubling: in round r every node whose depth is 2^r or more hands its sum so far to the ancestor 2^r above, and its
pointer jumps on to that ancestor's pointer.  So round r adds what stands 2^r to 2^(r+1) - 1 below, there are log2(depth) rounds, and each handles
only the nodes of that depth or more.  Every round is a table in the shared folder.

The digest of a node's ending members is of one string in the order of ids.  Rows are range-partitioned by node and id, joined to pieces of that string
batch by batch, and only the pieces of a node meet; they are streamed through the hash, so no list of members is held anywhere.

Odd cases.  A null conv_id is no conversation; its rows are left out.  Turns of the same number, null too, go by the digest of role and text; a repeated row is a
repeated turn.  Null roles and texts count as empty.  A conversation is there if it has a row, so it may be rebuilt without a turn and then ends in the root.  An empty
table gives no rows, as a root without members has no smallest one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Conversations of one family share the first turns of the family's first, up to MOST_SHARED - 1.
FAMILY, MOST_SHARED = 5, 9
GROUP = 32
ROOT = ""


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn, size) in order of turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("number"), digest.alias("turn"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv_id", "number", "turn"]
    # the upper bits of the row number are the partition, the lower ones count its rows
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)).drop("number")
    dealt = materialise(dealt, "turns")
    runs = dealt.groupBy("conv_id", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("run")) - F.col("n")
    runs = runs.select("conv_id", "run", (before - F.col("first")).alias("shift"))
    return dealt.join(runs, ["conv_id", "run"]).select("conv_id", (F.col("at") + F.col("shift") + 1).alias("pos"), "turn", "size")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations(conv_id, n), turns): each conversation begins with the first turns of its family's first one, then goes on with its own."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("long")
    known = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = known.select("conv_id", "n", family.alias("base"), shared.alias("h")).join(first, "base", "left")
    heads = heads.withColumn("p", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = materialise(heads.select("conv_id", "base", "h", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "heads")
    # a family has FAMILY members at most, and no more than MOST_SHARED - 1 turns of its first are handed on
    lent = own.filter((F.col("pos") < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = lent.join(heads, "base").filter("pos <= h").select("conv_id", "pos", "turn", "size", "n")
    kept = own.join(heads.withColumnRenamed("n", "total"), "conv_id").filter("pos > h")
    kept = kept.select("conv_id", (F.col("p") + F.col("pos") - F.col("h")).alias("pos"), "turn", "size", F.col("total").alias("n"))
    return heads.select("conv_id", "n"), lent.unionByName(kept)


def prefixes(items: DataFrame, longest: int) -> DataFrame:
    """(conv_id, pos, size, node, parent) of items(conv_id, pos, turn, size, n): the names of the sequences of the first pos and pos - 1 items."""
    group = ((F.col("pos") - 1) / GROUP).cast("long")
    rows = items.groupBy("conv_id", group.alias("g"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "size"))).alias("a"))
    rows = rows.withColumn("whole", F.sha2(F.concat_ws("", "a.turn"), 256))
    alone = rows.filter(F.col("n") <= GROUP).withColumn("start", F.lit(ROOT)).withColumn("end", F.sha2(F.concat(F.lit(ROOT), "whole"), 256))
    out = alone
    if longest > GROUP:
        many = materialise(rows.filter(F.col("n") > GROUP), "groups")
        above = many.select("conv_id", (F.col("g") + 1).alias("pos"), F.col("whole").alias("turn"), F.lit(0).cast("long").alias("size"), F.ceil(F.col("n") / GROUP).alias("n"))
        names = prefixes(above, -(-longest // GROUP)).select("conv_id", (F.col("pos") - 1).alias("g"), F.col("parent").alias("start"), F.col("node").alias("end"))
        out = alone.unionByName(many.join(names, ["conv_id", "g"]))
    name = lambda i: F.when(i == GROUP, F.col("end")).otherwise(F.sha2(F.concat("start", F.concat_ws("", F.slice(F.col("a.turn"), F.lit(1), i))), 256))
    out = out.withColumn("names", F.transform(F.sequence(F.lit(1), F.size("a")), name))
    each = out.select("conv_id", "start", "names", F.posexplode("a").alias("i", "x"))
    parent = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("names", F.col("i") - 1))
    return each.select("conv_id", F.col("x.pos").alias("pos"), F.col("x.size").alias("size"), F.get("names", F.col("i")).alias("node"), parent.alias("parent"))


def subtree_sums(nodes: DataFrame, deepest: int, columns: list[str]) -> DataFrame:
    """(node, *columns): sums of the columns over what stands below each node of nodes(node, parent, depth, *columns); nodes with nothing below are not named."""
    active = nodes.filter("depth > 0").select("node", "depth", F.col("parent").alias("jump"), *columns)
    credits, step = None, 1
    while step <= deepest:
        credit = materialise(active.groupBy(F.col("jump").alias("node")).agg(*[F.sum(c).alias(c) for c in columns]), "credits")
        credits = credit if credits is None else credits.unionByName(credit)
        step *= 2
        if step <= deepest:
            deep = active.filter(F.col("depth") >= step)
            more = credit.select("node", *[F.col(c).alias(f"more_{c}") for c in columns])
            onward = active.select(F.col("node").alias("jump"), F.col("jump").alias("onward"))
            deep = deep.join(more, "node", "left").join(onward, "jump")
            active = materialise(deep.select("node", "depth", F.col("onward").alias("jump"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns]), "jumps")
    if credits is None:
        return nodes.select("node", *columns).limit(0)
    return credits.groupBy("node").agg(*[F.sum(c).alias(c) for c in columns])


def _pieces(batches):
    """Ids in order as comma-joined pieces: a row for each stretch of one node within a batch."""
    for pdf in batches:
        if len(pdf):
            node = pdf["node"].to_numpy()
            stretch = (node[1:] != node[:-1]).cumsum()
            key = [0, *stretch.tolist()]
            ids = pdf["conv_id"].astype(str).groupby(key)
            first = pdf.groupby(key).first()
            yield pd.DataFrame({"node": first["node"], "first": first["conv_id"], "piece": ids.agg(",".join)})


def _hashed(batches):
    """The digest of each node's pieces, which come in order; one node is open at a time."""
    node = state = None
    for pdf in batches:
        done = []
        for name, piece in zip(pdf["node"], pdf["piece"]):
            if name != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends(node, conv_id)."""
    rows = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = rows.mapInPandas(_pieces, "node string, first long, piece string")
    met = pieces.repartition("node").sortWithinPartitions("node", "first")
    return met.mapInPandas(_hashed, "node string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = materialise(turns(conversations), "numbered")
    convs, rows = rebuilt(own)
    longest = convs.agg(F.max("n")).first()[0] or 0
    named = materialise(prefixes(rows, longest).join(convs, "conv_id").withColumn("last", F.col("pos") == F.col("n")).drop("n"), "named")
    nodes = named.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("pos").alias("depth"), F.first("size").alias("size"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "n_convs", "conv_id")
    nodes = materialise(nodes.unionByName(root), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    nodes = materialise(nodes.drop("size"), "nodes")
    below = subtree_sums(nodes, longest, ["n_leaves", "saved_tokens"])
    below = below.select("node", F.col("n_leaves").alias("leaves_below"), F.col("saved_tokens").alias("saved_below"))
    ends = end_digests(named.filter("last").select("node", "conv_id").unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("node"), "conv_id")))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH turn AS (
  SELECT conv_id, turn AS number, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
         strlen(coalesce(text, ''))::BIGINT AS n
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'x': x, 'n': n} ORDER BY number NULLS FIRST, x) AS s FROM turn GROUP BY conv_id
), bits AS (
  SELECT conv_id, s, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_transform(range(0, 8), lambda i: (ord(c)::BIGINT >> i) & 1))) AS b FROM own
), shared AS (
  SELECT conv_id, s, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, i: xor(a >> 1, 3988292384 * (xor(a, i) & 1))), 4294967295::BIGINT) % 9 AS h FROM bits
), conv AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(f.s, 1, c.h), []), list_slice(c.s, c.h + 1, len(c.s))) AS s
  FROM shared c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5
), member AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM conv
), node AS (
  SELECT d, list_slice(s, 1, d) AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len(s)), '')) AS ends_sha256
  FROM member GROUP BY d, list_slice(s, 1, d)
), children AS (
  SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), own_sums AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * n.p[n.d].n ELSE 0 END AS saved
  FROM node n LEFT JOIN children c ON c.d = n.d AND c.p = n.p
), up AS (
  SELECT p, n_children, saved, unnest(range(0, d + 1)) AS a FROM own_sums
), sums AS (
  SELECT a AS d, list_slice(p, 1, a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL
)
SELECT o.conv_id, o.d::BIGINT AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own_sums o JOIN sums s ON s.d = o.d AND s.p = o.p LEFT JOIN node q ON q.d = o.d - 1 AND q.p = list_slice(o.p, 1, o.d - 1)
"""
