"""MinHash near-duplicates (operator 7): chosen-path set similarity join.

1. Each text becomes its set of 64-bit shingle hashes and `coordinates` minwise hashes of it.  Equal sets collapse to one
   representative (its smallest id), so copies cost nothing further.
2. Chosen paths: each of `trees` independent trees selects a minwise coordinate at its root; documents with the same token
   there share a node.  A node of more than `node_size` documents branches again, along two coordinates drawn for that node,
   to `depth` levels.  Two documents at similarity s part in every tree only with probability (1 - s)^trees at the first
   level: 6e-8 for 12 trees at 0.75; two branches a node keep the deeper paths alive.
3. Nodes are compared exhaustively on their minwise hashes, but only as far as it can change the outcome: pairs whose
   estimate is under `estimate` are dropped, and documents that hang together already are not compared again.  A node gives
   a spanning forest, never all its pairs.  Nodes beyond `block` documents are dealt out as pairs of blocks.
4. The forests' components are candidate classes.  Inside each class links are decided on full shingle sets
   (intersection >= 0.75 union), again as a spanning forest and in pairs of blocks of bounded bytes.  There the texts
   themselves are compared: words are numbered by their bytes, shingles by five such numbers; no hash decides a link.
5. Components of the confirmed links are the answer.

Equal sets are told by 128 bits over two independent hashes of every word.  Documents without words are linked with nothing.
A text of any length is one set; it takes about 40 times its size in memory.  Defined cases: a null text has no words; rows with one id and different
texts are one node; repeated rows are each returned; a row with a null doc_id is returned with a null component and is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LANES, U64, exact_ids, exact_spans, lower_ascii, materialise, mix, read_documents, slices, text_buffer, word_hashes, words_of
from .components import components

COORDINATES = 64
_ODD = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_XOR = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after another, how many each row has, a second hash of each row's set)."""
    n = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    made = np.maximum(count - width + 1, np.minimum(count, 1))  # shingles before duplicates go
    owner = np.repeat(np.arange(n), made)
    at = first[owner] + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    size = np.minimum(count, width)[owner]
    lanes = []
    with np.errstate(over="ignore"):
        for lane in (0, 1):
            h = word_hashes(data, start, end, lane)
            g = size.astype(U64) * LANES[lane]
            for k in range(width):
                place = np.minimum(at + k, max(0, len(h) - 1))
                term = h[place] ^ U64((k + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) if len(h) else h
                g = mix(g * LANES[1 - lane] + np.where(k < size, term, U64(0)))
            lanes.append(g)
        parts, second = [], np.zeros(n, U64)
        ends = np.cumsum(made)
        for i, (a, b) in enumerate(zip((ends - made).tolist(), ends.tolist())):
            own, where = np.unique(lanes[0][a:b], return_index=True)
            parts.append(own)
            second[i] = lanes[1][a:b][where].sum(dtype=U64)
    return (np.concatenate(parts) if parts else lanes[0]), np.fromiter(map(len, parts), np.int64, n), second


def exact_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle set of each (lower-case) text as sorted numbers, which are equal where the words' bytes are."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, row = words_of(data, offsets)
    ids = exact_ids(data, start, end)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    name = exact_spans(ids, width) if len(ids) >= width else ids[:0]
    out = []
    for k, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        # a text of fewer words has a set like another's only if their words are equal: equal sets do not come here twice
        out.append(np.unique(name[a : a + n - width + 1]) if n >= width else np.array([-1 - k] * min(n, 1), np.int64))
    return out


def sketches(hashes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """k minwise values (uint32) of each set; empty sets have the largest value."""
    out = np.full((len(sizes), k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = (np.cumsum(sizes) - sizes)[full]
    with np.errstate(over="ignore"):
        for i in range(k):
            v = (((hashes ^ _XOR[i]) * _ODD[i]) >> U64(32)).astype(np.uint32)
            out[full, i] = np.minimum.reduceat(v, first)
    return out


def _sets(docs: DataFrame, width: int, k: int, full: bool) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch[, lower-case text]) of each row of docs(doc_id, text)."""
    schema = "doc_id long, n_shingles long, set_key binary, sketch binary" + (", low binary" if full else "")

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for i, j in slices(offsets, 1 << 20):
                part = lower_ascii(data[offsets[i] : offsets[j]])
                h, sizes, second = shingle_sets(part, offsets[i : j + 1] - offsets[i], width)
                s = sketches(h, sizes, k)
                ends = np.cumsum(sizes)
                raw = [h[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                keys = [hashlib.blake2b(r, digest_size=8).digest() + x for r, x in zip(raw, map(bytes, second.view("V8")))]
                cols = [b.column(0)[i:j], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in s], pa.binary())]
                names = ["doc_id", "n_shingles", "set_key", "sketch"]
                if full:
                    cut = (offsets[i : j + 1] - offsets[i]).tolist()
                    cols.append(pa.array([part[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()))
                    names.append("low")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Forest:
    """Union-find over 0..n-1 that remembers the links it took."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.links.append((x, y))
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.root, range(len(self.up))), np.int64, len(self.up))


def _alike(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Equal coordinates of row x with all rows."""
    return (s == x).sum(axis=1)


def node_forest(sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with at least `least` equal coordinates."""
    n = len(sketch)
    f = Forest(n)
    open_ = np.ones(n, bool)
    for x in range(n):  # a node already compared with all others need not be compared again
        roots = f.roots() if n > 32 else None
        if roots is not None:
            big = np.bincount(roots).argmax()
            rest = np.flatnonzero((roots != big) & open_)
            if not len(rest):
                break
            x = int(rest[0]) if x else 0
        if not open_[x]:
            continue
        open_[x] = False
        for y in np.flatnonzero(_alike(sketch, sketch[x]) >= least).tolist():
            if y != x:
                f.join(x, y)
    return f.links


def set_forest(sets: list[np.ndarray], sketch: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with 100 |A n B| >= percent |A u B|; sets are sorted distinct hashes."""
    n = len(sets)
    f = Forest(n)
    size = np.fromiter(map(len, sets), np.int64, n)
    open_ = np.ones(n, bool)
    x = int(size.argmax()) if n else 0
    while True:
        open_[x] = False
        likely = (_alike(sketch, sketch[x]) >= least) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        likely[x] = False
        for y in np.flatnonzero(likely).tolist():
            if f.root(x) == f.root(y):
                continue
            both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
            if 100 * both >= percent * (size[x] + size[y] - both):
                f.join(x, y)
        roots = f.roots()
        big = np.bincount(roots).argmax()
        rest = np.flatnonzero((roots != big) & open_)
        if not len(rest):
            return f.links
        x = int(rest[0])


def runs(batches, keys: int):
    """Rows of an Arrow stream sorted by its first `keys` columns, as tables of whole groups with the groups' borders."""
    held = []

    def flush(t):
        t = t.combine_chunks()
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for k in range(keys):
            c = t.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        return t, np.concatenate(([0], np.flatnonzero(change) + 1, [t.num_rows]))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        last = [b.column(k)[b.num_rows - 1].as_py() for k in range(keys)]
        if len(held) > 1 and last == [held[0].column(k)[0].as_py() for k in range(keys)]:
            continue  # still the same group
        t, borders = flush(pa.Table.from_batches(held))
        if len(borders) > 2:
            yield t.slice(0, borders[-2]), borders[:-1]
            held = t.slice(borders[-2]).combine_chunks().to_batches()
    if held:
        yield flush(pa.Table.from_batches(held))


def _matrix(column, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, k)


def blocked(rows: DataFrame, key: str, weight, most: int) -> DataFrame:
    """rows with (i, j): groups of more than `most` weight are dealt out as pairs of blocks, each row to every pair of its block."""
    size = rows.groupBy(key).agg(F.sum(weight).alias("__w"))
    blocks = F.ceil(F.col("__w") / F.lit(float(most))).cast("int")
    b = F.pmod(F.xxhash64("rep"), F.col("__blocks")).cast("int")
    out = rows.join(size.select(key, F.greatest(blocks, F.lit(1)).alias("__blocks")), key).withColumn("__b", b)
    out = out.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return out.withColumns({"i": F.least("__b", "__c"), "j": F.greatest("__b", "__c")}).drop("__w", "__blocks", "__b", "__c")


def _by_key(rows: DataFrame, cols: list[str], fn) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cols[:3]
    return rows.select(*cols).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(fn, "a long, b long")


def _edges(pairs):
    a, b = (np.array(x, np.int64) for x in zip(*pairs))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def chosen_paths(reps: DataFrame, *, k: int, trees: int, node_size: int, depth: int, block: int, estimate: float) -> DataFrame:
    """Candidate links (a, b): spanning forests of the tree nodes.  reps: (rep, sketch)."""
    least = int(np.ceil(estimate * k))

    def branch(at_depth: int):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                names = b.schema.names
                rep, s = b.column(names.index("rep")), _matrix(b.column(names.index("sketch")), k)
                node = np.zeros(len(s), U64) if "node" not in names else b.column(names.index("node")).to_numpy().astype(np.int64).view(U64)
                made = []
                with np.errstate(over="ignore"):
                    for t in range(trees if at_depth == 0 else 2):
                        # roots: a coordinate of its own for each tree; deeper: drawn for the node
                        draw = np.full(len(s), (t * k) // trees) if at_depth == 0 else (mix(node + U64(t * 7919 + at_depth)) % U64(k)).astype(np.int64)
                        token = s[np.arange(len(s)), draw].astype(U64)
                        made.append(mix(mix(node + draw.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(t + 1)) ^ token).view(np.int64))
                key = np.concatenate(made)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.concat_arrays([rep] * len(made))], names=["node", "rep"])

        return run

    def compare(batches):
        for t, borders in runs(batches, 3):
            rep, s = t.column("rep").to_numpy(), _matrix(t.column("sketch"), k)
            size = np.diff(borders)
            pairs = []
            two = borders[:-1][size == 2]
            hit = two[(s[two] == s[two + 1]).sum(axis=1) >= least]
            pairs += zip(rep[hit].tolist(), rep[hit + 1].tolist())
            for a, n in zip(borders[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = rep[a : a + n]
                pairs += [(int(own[x]), int(own[y])) for x, y in node_forest(s[a : a + n], least)]
            pairs = [p for p in set(pairs) if p[0] != p[1]]
            if pairs:
                yield _edges(pairs)

    sketch = reps.select("rep", "sketch")
    rows, made = sketch, None
    for d in range(depth):
        children = rows.mapInArrow(branch(d), "node long, rep long").distinct()
        sizes = children.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        children = materialise(children.join(sizes, "node"), "paths")
        small = children if d == depth - 1 else children.filter(F.col("n") <= node_size)
        made = small if made is None else made.unionByName(small)
        if d < depth - 1:
            large = children.filter(F.col("n") > node_size)
            if large.isEmpty():
                break
            rows = large.select("node", "rep").join(sketch, "rep").select("node", "rep", "sketch")
    pairs = blocked(made.select("node", "rep"), "node", F.lit(1), block).join(sketch, "rep")
    return _by_key(pairs, ["node", "i", "j", "rep", "sketch"], compare)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    coordinates: int = COORDINATES,
    trees: int = 12,
    node_size: int = 256,
    depth: int = 3,
    block: int = 8192,
    block_bytes: int = 16 << 20,
    estimate: float = 0.5,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialise(_sets(d, width, coordinates, False), "sets")
    ids = sets.filter("doc_id IS NOT NULL AND n_shingles > 0")
    reps = ids.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # equal sets have equal sketches; a rep's own row is found again by its id
    own = ids.select("doc_id", "set_key", "n_shingles", "sketch").dropDuplicates(["doc_id", "set_key"])
    rep_rows = materialise(
        reps.join(own.withColumnRenamed("doc_id", "rep"), ["rep", "set_key", "n_shingles"]).select("rep", "set_key", "n_shingles", "sketch"), "reps"
    )
    least = int(np.ceil(estimate * coordinates))
    paths = chosen_paths(rep_rows, k=coordinates, trees=trees, node_size=node_size, depth=depth, block=block, estimate=estimate)
    classes = materialise(components(paths), "classes").withColumnRenamed("node", "rep")
    wanted = rep_rows.join(classes, "rep").select("rep", "component", "n_shingles", "set_key")

    def confirm(batches):
        for t, borders in runs(batches, 3):
            rep, s = t.column("rep").to_numpy(), _matrix(t.column("sketch"), coordinates)
            raw = t.column("low").to_pylist()
            pairs = []
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                got = exact_sets(raw[a:b], width)
                pairs += [(int(rep[a + x]), int(rep[a + y])) for x, y in set_forest(got, s[a:b], least, percent)]
            pairs = [p for p in set(pairs) if p[0] != p[1]]
            if pairs:
                yield _edges(pairs)

    spread = blocked(wanted, "component", 8 * F.col("n_shingles") + 512, block_bytes)
    texts = d.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    full = _sets(texts, width, coordinates, True).dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("rep"), "set_key", "sketch", "low")
    links = _by_key(spread.join(full, ["rep", "set_key"]), ["component", "i", "j", "rep", "sketch", "low"], confirm)
    # rows of one id with different texts are one node, and so are copies and their representative
    copies = sets.filter("doc_id IS NOT NULL AND n_shingles > 0").join(reps, ["set_key", "n_shingles"]).filter("doc_id != rep")
    copies = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::bigint AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n_shingles + q.n_shingles - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, edge.b FROM reach r JOIN edge ON edge.a = r.other)
SELECT n.doc_id, n.n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n_shingles"""
