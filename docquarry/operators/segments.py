"""A corpus as immutable segments under one manifest: additions, refreshes and removals write what is new and nothing else.

A segment is a folder of each table below `path`: documents, chunks, vectors, postings, lengths.  A manifest is a small numbered file that names the segments
and the removals that count, each with a sequence number, so documents, chunks and full-text index are always of one state.  A removal names documents and ends
all their rows in segments of a smaller number; of several rows of one document in `documents` the one of the largest number counts.

Writers commit by creating the next manifest, which only one of them can.  The other looks at what came between: registrations of the same paths are judged
anew, data of a document that is gone by now, or a merge of segments that are gone, is a Conflict; everything else is put on top of the new state.
Neighbouring segments of one size class are merged when FAN of them stand together, so a row is written again once for each class.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import ann, fts, store, vectors
from docquarry.plans import schemas
from docquarry.sources import storage

_ddl = lambda s: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s)
TABLES = {
    "documents": _ddl(schemas.DOCUMENTS),
    "chunks": _ddl(schemas.CHUNKS),
    "vectors": _ddl(schemas.VECTORS),
    "postings": "id bigint, token string, positions array<int>, dl bigint",
    "lengths": "id bigint, dl bigint",
}
#: Segments of one size class that are merged; tokens of a postings file; neighbours that the vector index is measured with.
FAN, PER_FILE, NEIGHBOURS = 8, 500_000, 50


class Conflict(RuntimeError):
    """Another writer's commit makes this one wrong; do it again from the new state."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    kind: str = "empty"
    seq: int = 0  # the largest number given so far
    next_id: int = 1
    segments: tuple = ()  # of {"name", "seq", "rows": {table: rows}}, by seq
    removals: tuple = ()  # of {"name", "seq"}
    chunks: int = 0  # live rows of lengths, and their tokens
    tokens: int = 0
    vectors: tuple = ()  # of {"name", "seq"}: the vector index and the newest segment that it covers

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def of(cls, text: str) -> "Manifest":
        raw = json.loads(text)
        return cls(**raw | {"segments": tuple(raw["segments"]), "removals": tuple(raw["removals"]), "vectors": tuple(raw.get("vectors", ()))})


def document_of(chunk_id):
    return F.shiftright(chunk_id, store.POSITION_BITS)


@dataclass
class Segments:
    """A state of the corpus below `path`."""

    spark: SparkSession
    path: str
    head: Manifest = field(default_factory=Manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> "Segments":
        """The newest state, or an earlier one; a folder without manifests is an empty corpus."""
        known = [int(n.removesuffix(".json")) for n in storage.names(spark, f"{path}/manifests") if n.endswith(".json")]
        if version is not None and version not in known:
            raise FileNotFoundError(f"{path}: no version {version}")
        last = max(known, default=0) if version is None else version
        return cls(spark, path, Manifest.of(storage.get(spark, f"{path}/manifests/{last:08}.json")) if last else Manifest())

    # -- reading

    def _removed(self, removals) -> DataFrame | None:
        """(document_id, upto): the largest number of a removal of each document."""
        if not removals:
            return None
        number = F.create_map(*[F.lit(x) for r in removals for x in (r["name"], r["seq"])])
        rows = self.spark.read.schema("document_id long, removal string").option("basePath", f"{self.path}/removed").parquet(*[f"{self.path}/removed/removal={r['name']}" for r in removals])
        return rows.groupBy("document_id").agg(F.max(number[F.col("removal")]).alias("upto"))

    def rows(self, table: str, segments=None, state: Manifest | None = None) -> DataFrame:
        """Live rows of a table: of all segments, or of some."""
        state = state or self.head
        of = [s for s in (state.segments if segments is None else segments) if s["rows"].get(table)]
        if not of:
            return self.spark.createDataFrame([], TABLES[table])
        where = [f"{self.path}/{table}/segment={s['name']}" for s in of]
        df = self.spark.read.schema(f"{TABLES[table]}, segment string").option("basePath", f"{self.path}/{table}").parquet(*where)
        columns = [c for c in df.columns if c != "segment"]
        df = df.withColumn("__seq", F.create_map(*[F.lit(x) for s in of for x in (s["name"], s["seq"])])[F.col("segment")])
        # a removal matters only to segments of smaller numbers
        gone = self._removed([r for r in state.removals if r["seq"] > min(s["seq"] for s in of)])
        if gone is not None:
            key = {"documents": F.col("id"), "chunks": F.col("document_id"), "vectors": F.col("document_id")}.get(table, document_of("id"))
            df = df.withColumn("__doc", key).join(gone.withColumnRenamed("document_id", "__doc"), "__doc", "left").filter("upto IS NULL OR upto <= __seq")
        if table == "documents" and len(of) > 1:
            return store.newest(df.select(*columns, "__seq"), "id", "__seq").select(*columns)
        return df.select(*columns)

    @property
    def documents(self) -> DataFrame:
        return self.rows("documents")

    @property
    def store(self) -> store.Store:
        return store.Store(self.rows("documents"), self.rows("chunks"), self.rows("vectors"))

    @property
    def index(self) -> fts.Index:
        """Postings lie in order of token, so a query's tokens are found by the files' statistics; the totals are in the manifest."""
        h = self.head
        stats = self.spark.range(1).select(F.lit(float(h.chunks)).alias("docs"), F.lit(h.tokens / h.chunks if h.chunks else None).cast("double").alias("avgdl"))
        return fts.Index(self.rows("postings"), self.rows("lengths"), stats)

    # -- committing

    def _commit(self, change: Callable[["Segments"], Manifest]) -> "Segments":
        """change(state) gives the manifest that follows a state; it is asked again for as long as another writer comes first."""
        at = self
        while True:
            new = change(at)
            new = replace(new, version=at.head.version + 1)
            if storage.put_new(self.spark, f"{self.path}/manifests/{new.version:08}.json", new.text()):
                return Segments(self.spark, self.path, new)
            at = Segments.open(self.spark, self.path)

    def _write(self, table: str, df: DataFrame, name: str, files: int = 0) -> tuple[int, int]:
        """(rows, tokens) written as a table of a segment; tokens for lengths.  Counted as they are written."""
        if files:
            df = df.repartitionByRange(files, "token", "id").sortWithinPartitions("token", "id")
        seen = Observation()
        df = df.select(*[c.split()[0] for c in TABLES[table].split(", ")])
        tokens = F.coalesce(F.sum("dl"), F.lit(0)) if table == "lengths" else F.lit(0)
        df.observe(seen, F.count(F.lit(1)).alias("rows"), tokens.alias("tokens")).write.parquet(f"{self.path}/{table}/segment={name}")
        return seen.get["rows"], seen.get["tokens"]

    def _remove(self, ids: DataFrame) -> tuple[str, int]:
        """(name, rows) of a written removal of ids(id)."""
        name, seen = uuid.uuid4().hex, Observation()
        rows = ids.select(F.col("id").alias("document_id")).distinct().observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.parquet(f"{self.path}/removed/removal={name}")
        return name, seen.get["rows"]

    def _lost(self, name: str) -> tuple[int, int]:
        """(rows, tokens) of live lengths whose documents a removal names."""
        gone = self.spark.read.schema("document_id long").parquet(f"{self.path}/removed/removal={name}")
        lost = self.rows("lengths").withColumn("document_id", document_of("id")).join(gone, "document_id", "left_semi")
        return tuple(lost.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def _ended(self, h: Manifest, name: str, rows: int) -> Manifest:
        """h with a removal under its newest number."""
        if not rows:
            return h
        lost, tokens = self._lost(name)
        return replace(h, removals=(*h.removals, {"name": name, "seq": h.seq}), chunks=h.chunks - lost, tokens=h.tokens - tokens)

    def register(self, paths: DataFrame) -> "Segments":
        """New documents (document_path, name), pending; an old document of the same path goes with all that hangs on it.

        Ids are taken first, in a commit of their own, so no two writers have the same.  Of several names for one path the smallest stays.
        """
        new = paths.groupBy("document_path").agg(F.min("name").alias("name"))
        n = new.count()
        if not n:
            return self
        held = self._commit(lambda at: replace(at.head, kind="ids", next_id=at.head.next_id + n))
        first, name = held.head.next_id - n, uuid.uuid4().hex
        numbered = store.numbered(new, "document_path").select((F.lit(first) + F.col("place")).cast("long").alias("id"), "document_path", "name", F.lit(False).alias("is_indexed"))
        rows, _ = held._write("documents", numbered, name)
        own = self.spark.read.schema(TABLES["documents"]).parquet(f"{self.path}/documents/segment={name}")

        def change(at: "Segments") -> Manifest:
            gone = at.documents.join(own.select("document_path"), "document_path", "left_semi").select("id")
            h = replace(at.head, kind="register", seq=at.head.seq + 1)
            h = at._ended(h, *at._remove(gone))
            return replace(h, segments=(*h.segments, {"name": name, "seq": h.seq, "rows": {"documents": rows}}))

        return held._commit(change)

    def rename(self, id_: int, name: str) -> "Segments":
        """A new name for a document; an unknown id changes nothing."""

        def change(at: "Segments") -> Manifest:
            changed = store.rename(store.by_id(at.documents, id_), id_, name)
            own = uuid.uuid4().hex
            rows, _ = at._write("documents", changed, own)
            h = replace(at.head, kind="rename", seq=at.head.seq + 1)
            return replace(h, segments=(*h.segments, {"name": own, "seq": h.seq, "rows": {"documents": rows}})) if rows else replace(at.head, kind="rename")

        return self._commit(change)

    def delete(self, ids: DataFrame) -> "Segments":
        """Without the documents ids(id), their chunks, vectors and postings."""
        name, rows = self._remove(ids)

        def change(at: "Segments") -> Manifest:
            return at._ended(replace(at.head, kind="delete", seq=at.head.seq + 1), name, rows)

        return self._commit(change)

    def put_chunks(self, chunks: DataFrame, vectors_: DataFrame, refreshed: DataFrame | None = None) -> "Segments":
        """Chunks, vectors and postings of some documents replace all that these had; the documents count as indexed.

        refreshed(id): the documents that were parsed, those without any chunk as well; by default the ones that have chunks.
        """
        name, own = uuid.uuid4().hex, {}
        ids = (chunks.select(F.col("document_id").alias("id")) if refreshed is None else refreshed.select("id")).distinct()
        removal, n = self._remove(ids)
        done = self.spark.read.schema("document_id long").parquet(f"{self.path}/removed/removal={removal}").select(F.col("document_id").alias("id"))
        own["chunks"], _ = self._write("chunks", chunks, name)
        own["vectors"], _ = self._write("vectors", vectors_, name)
        made = fts.build_index(self.spark.read.schema(TABLES["chunks"]).parquet(f"{self.path}/chunks/segment={name}"), "id", "raw_text")
        own["lengths"], tokens = self._write("lengths", made.lengths, name)
        own["postings"], _ = self._write("postings", made.postings, name, max(1, -(-tokens // PER_FILE)))

        def change(at: "Segments") -> Manifest:
            segment = uuid.uuid4().hex
            indexed = at.documents.join(done, "id", "left_semi").withColumn("is_indexed", F.lit(True))
            rows, _ = at._write("documents", indexed, segment)
            if rows != n:
                raise Conflict(f"{n - rows} of {n} documents are not there any more")
            h = replace(at.head, kind="chunks", seq=at.head.seq + 1)
            h = at._ended(h, removal, n)
            pair = ({"name": segment, "seq": h.seq, "rows": {"documents": rows}}, {"name": name, "seq": h.seq, "rows": own})
            return replace(h, segments=(*h.segments, *pair), chunks=h.chunks + own["lengths"], tokens=h.tokens + tokens)

        return self._commit(change)

    # -- vectors

    def index_vectors(self, least: int = ann.LEAST_ROWS) -> "Segments":
        """A vector index of all live vectors, in place of an older one; with fewer than `least` rows there is none, and search stays exact."""
        rows, name = self.rows("vectors"), uuid.uuid4().hex
        built = ann.VectorIndex.build(rows, f"{self.path}/ann/{name}", k=NEIGHBOURS, id_col="chunk_id", vector_col="vector") if rows.count() >= least else None
        made = ({"name": name, "seq": self.head.seq},) if built else ()
        return self._commit(lambda at: replace(at.head, kind="vectors", vectors=made))

    def near(self, query: list[float], k: int = 200) -> DataFrame:
        """(id, distance) of the k nearest chunks: from the index where there is one, and exactly from the segments that it does not cover.

        What was removed since the index was made, and what was merged into newer segments, is passed over in it and found in those.
        """
        made = next(iter(self.head.vectors), None)
        covered = [s for s in self.head.segments if made and s["seq"] <= made["seq"]]
        if not covered:  # no index, or a merge has made all that it knows anew
            return vectors.knn(self.rows("vectors"), query, k, "chunk_id", "vector")
        index = ann.VectorIndex.read(self.spark, f"{self.path}/ann/{made['name']}")
        newer, later = [s for s in self.head.segments if s["seq"] > made["seq"]], [r for r in self.head.removals if r["seq"] > made["seq"]]
        if not newer and not later:
            return index.search(query, k)
        fresh = self.rows("vectors", newer)
        dead = fresh.select(F.col("chunk_id").alias("id"))
        if later:  # none of them can have been dropped while an older segment stands
            known = index.parts().select("part", "ids").mapInPandas(ann.ids_of_parts, "part string, id long")
            dead = dead.unionByName(known.withColumn("document_id", document_of("id")).join(self._removed(later), "document_id", "left_semi").select("id"))
        found = index.search(query, k, dead=dead).unionByName(vectors.knn(fresh, query, k, "chunk_id", "vector"))
        return found.orderBy("distance", "id").limit(k)

    # -- merging

    def due(self, fan: int = FAN) -> list[dict]:
        """The first run of neighbouring segments of one size class that is long enough to be merged."""
        run: list[dict] = []
        size = lambda s: max(1, sum(s["rows"].values()))
        rank = lambda s: next(k for k in range(99) if size(s) < 100 * fan ** (k + 1))
        for s in self.head.segments:
            run = [*run, s] if run and rank(run[-1]) == rank(s) else [s]
            # all segments of one commit go together
            if len(run) >= fan and not any(x["seq"] == s["seq"] and x not in run for x in self.head.segments):
                return run
        return []

    def merge(self, segments: list[dict] | None = None, fan: int = FAN) -> "Segments":
        """Neighbouring segments (all that are due by default) as one, without what was removed; removals that nothing needs any more go."""
        if segments is None:
            at = self
            while run := at.due(fan):
                at = at.merge(run)
            return at
        names, seq = {s["name"] for s in segments}, max(s["seq"] for s in segments)
        between = [s for s in self.head.segments if min(x["seq"] for x in segments) <= s["seq"] <= seq]
        if {s["name"] for s in between} != names:
            raise ValueError("only neighbouring segments can be merged")
        name = uuid.uuid4().hex
        rows, tokens = {}, 0
        for t in ("lengths", "postings", "documents", "chunks", "vectors"):
            if any(s["rows"].get(t) for s in segments):
                rows[t], n = self._write(t, self.rows(t, segments), name, max(1, -(-tokens // PER_FILE)) if t == "postings" else 0)
                tokens += n

        def change(at: "Segments") -> Manifest:
            if not names <= {s["name"] for s in at.head.segments}:
                raise Conflict("another writer has merged these segments")
            left = [s for s in at.head.segments if s["name"] not in names]
            kept = sorted([*left, {"name": name, "seq": seq, "rows": rows}], key=lambda s: s["seq"])
            first = min(s["seq"] for s in kept)
            return replace(at.head, kind="merge", segments=tuple(kept), removals=tuple(r for r in at.head.removals if r["seq"] > first))

        return self._commit(change)

    def vacuum(self, keep: int = 2) -> None:
        """Remove what only older states than the `keep` newest name, once no reader needs it and no writer is at work."""
        known = sorted(int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.path}/manifests") if n.endswith(".json"))
        kept = [Segments.open(self.spark, self.path, v).head for v in known[-max(1, keep) :]]
        named = {x["name"] for h in kept for x in (*h.segments, *h.removals, *h.vectors)}
        for folder in (*TABLES, "removed", "ann"):
            for n in storage.names(self.spark, f"{self.path}/{folder}"):
                if n.split("=")[-1] not in named:
                    storage.remove(self.spark, f"{self.path}/{folder}/{n}")
        for v in known[: -max(1, keep)]:
            storage.remove(self.spark, f"{self.path}/manifests/{v:08}.json")
