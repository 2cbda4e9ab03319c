"""Segments under one manifest: states, conflicts, merges, what is written."""

import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.operators import ann, fts, indexing, store, vectors
from docquarry.operators.segments import TABLES, Conflict, Segments
from docquarry.plans import catalog
from docquarry.sources import parsers, storage
from docquarry.sources.corpora import Config


def paths(spark, *names):
    return spark.createDataFrame([(f"/{n}", n) for n in names], "document_path string, name string")


def put(s, texts):
    """Chunks of pending documents by name: one chunk for each text."""
    spark = s.spark
    ids = {r["name"]: r.id for r in s.documents.collect()}
    rows = [((ids[n] << 20) + i, ids[n], i, ["x"], 1, "m", t) for n, own in texts.items() for i, t in enumerate(own)]
    chunks = spark.createDataFrame(rows, TABLES["chunks"])
    vectors = spark.createDataFrame([(r[0], r[1], [1.0]) for r in rows], TABLES["vectors"])
    return s.put_chunks(chunks, vectors, spark.createDataFrame([(ids[n],) for n in texts], "id long"))


def found(s, query):
    names = {r.id: r["name"] for r in s.documents.collect()}
    return [(names[r.id >> 20], r.score) for r in fts.bm25(s.index, query).collect()]


def same_as_rebuilt(s, query):
    """The stored index gives what an index of the live chunks, made at once, does; and the manifest's totals are those of the live rows."""
    fresh = fts.build_index(s.store.chunks, "id", "raw_text")
    live = s.rows("lengths").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    assert (s.head.chunks, s.head.tokens) == tuple(live)
    assert fts.bm25(s.index, query).collect() == fts.bm25(fresh, query).collect()
    assert s.store.vectors.select(F.col("chunk_id").alias("id")).exceptAll(s.store.chunks.select("id")).isEmpty()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    s = Segments.open(spark, str(tmp_path_factory.mktemp("seg") / "c"))
    assert s.documents.isEmpty() and s.head.version == 0
    s = s.register(paths(spark, "a", "b", "c"))
    return put(s, {"a": ["the cat sat", "on the mat"], "b": ["dogs and cats"], "c": []})


def test_states(spark, corpus):
    assert all(r.is_indexed for r in corpus.documents.collect()) and corpus.store.chunks.count() == 3
    same_as_rebuilt(corpus, "the")
    # an earlier state is still there, as it was
    old = Segments.open(spark, corpus.path, 2)
    assert old.store.chunks.isEmpty() and not any(r.is_indexed for r in old.documents.collect())
    with pytest.raises(FileNotFoundError):
        Segments.open(spark, corpus.path, 99)
    with pytest.raises(FileNotFoundError):
        indexing.Corpus.read(spark, corpus.path + "-nowhere")


def test_changes_and_merges(spark, tmp_path):
    s = Segments.open(spark, str(tmp_path / "c")).register(paths(spark, "a", "b", "c", "d"))
    s = put(s, {"a": ["the cat sat", "on the mat"], "b": ["the dog"], "c": ["the end"]})
    s = put(s, {"b": ["a bird", "the bird sings"]})  # refreshed: the same id, other chunks
    s = s.delete(s.documents.filter("name = 'c'").select("id")).rename(s.documents.filter("name = 'd'").first().id, "e")
    before = s.documents.filter("name = 'a'").first().id
    s = s.register(paths(spark, "a"))  # a new life of the same path
    assert s.documents.filter("name = 'a'").first().id > before and {r["name"]: r.is_indexed for r in s.documents.collect()} == {"a": False, "b": True, "e": False}
    assert found(s, "cat") == [] and [n for n, _ in found(s, "the")] == ["b"]
    same_as_rebuilt(s, "the")
    hits, documents = found(s, "bird"), sorted(s.documents.collect())
    assert len(s.head.removals) == 4
    merged = s.merge(list(s.head.segments))
    assert len(merged.head.segments) == 1 and merged.head.removals == ()
    assert found(merged, "bird") == hits and sorted(merged.documents.collect()) == documents
    same_as_rebuilt(merged, "the")
    merged.vacuum(1)
    assert {n.split("=")[1] for n in storage.names(spark, f"{s.path}/chunks")} <= {x["name"] for x in merged.head.segments} and storage.names(spark, f"{s.path}/removed") == []
    same_as_rebuilt(Segments.open(spark, s.path), "the")
    with pytest.raises(ValueError):
        x = merged.register(paths(spark, "f")).register(paths(spark, "g")).head.segments
        Segments.open(spark, s.path).merge([x[0], x[2]])


def test_a_middle_merge_keeps_later_removals(spark, tmp_path):
    s = Segments.open(spark, str(tmp_path / "c"))
    for n in ("a", "c"):
        s = put(s.register(paths(spark, n, f"{n}{n}")), {n: [f"the {n}"], f"{n}{n}": ["the the"]})
    old = s
    s = s.delete(s.documents.filter("name IN ('a', 'c')").select("id"))
    middle = [x for x in s.head.segments if 2 <= x["seq"] <= 4]
    s = s.merge(middle)
    assert sorted(n for n, _ in found(s, "the")) == ["aa", "cc"]
    same_as_rebuilt(s, "the")
    # a merge that began before the removal, and ends after it, does not bring anything back
    t = Segments(spark, old.path, s.head)
    first = [x for x in t.head.segments if x["seq"] <= 4]
    assert sorted(n for n, _ in found(t.merge(first), "the")) == ["aa", "cc"]


def test_two_writers(spark, tmp_path):
    base = put(Segments.open(spark, str(tmp_path / "c")).register(paths(spark, "a", "b")), {"a": ["one"], "b": ["two"]})
    # both register the same new path from the same state: one document of it is left, the later one
    one, two = base.register(paths(spark, "x", "y")), base.register(paths(spark, "x"))
    assert two.head.version > one.head.version
    rows = {r["name"]: r.id for r in two.documents.collect()}
    assert sorted(rows) == ["a", "b", "x", "y"] and two.documents.count() == 4 and len(set(rows.values())) == 4
    # chunks of a document that another writer has removed are refused
    gone = two.delete(two.documents.filter("name = 'y'").select("id"))
    with pytest.raises(Conflict):
        put(two, {"y": ["late"]})
    assert found(Segments.open(spark, base.path), "late") == []
    # a removal on top of a removal is put after it, and counts nothing twice
    again = two.delete(two.documents.filter("name IN ('y', 'a')").select("id"))
    assert again.head.version == gone.head.version + 1 and found(again, "one") == []
    same_as_rebuilt(again, "two")
    # two merges of the same segments
    again.merge(list(again.head.segments))
    with pytest.raises(Conflict):
        again.merge(list(again.head.segments))


def test_one_of_many_makes_the_file(spark, tmp_path):
    made = []
    go = [threading.Thread(target=lambda i=i: made.append(storage.put_new(spark, f"{tmp_path}/m/1.json", str(i)))) for i in range(6)]
    [t.start() for t in go], [t.join() for t in go]
    assert made.count(True) == 1 and len(list((tmp_path / "m").glob("*.draft"))) == 0


def test_additions_write_in_proportion(spark, tmp_path):
    import random

    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(250))
    s = Segments.open(spark, str(tmp_path / "c"))
    many = {f"d{i}": [text()] for i in range(300)}
    s = put(s.register(paths(spark, *many)), many)
    files = lambda: {p: p.stat().st_size for p in (tmp_path / "c").rglob("*.parquet")}
    first = files()
    few = {f"n{i}": [text()] for i in range(3)}
    s = put(s.register(paths(spark, *few)), few)
    after = files()
    assert all(after[p] == n for p, n in first.items()) and sum(after.values()) < 1.05 * sum(first.values())
    same_as_rebuilt(s, few["n1"][0].split()[5])


def test_small_segments_are_merged(spark, tmp_path):
    s = Segments.open(spark, str(tmp_path / "c"))
    for i in range(5):
        s = put(s.register(paths(spark, f"d{i}")), {f"d{i}": [f"text {i}"]}).merge(fan=4)
        assert len(s.head.segments) <= 6
    assert len(found(s, "text")) == 5
    same_as_rebuilt(s, "text")


def test_vector_index_of_a_corpus(spark, tmp_path):
    """Search through the index, with all of it walked, is exact search, whatever was added, refreshed, removed or merged since."""
    import random

    rng = random.Random(2)
    unit = lambda: [rng.gauss(0, 1) for _ in range(8)]
    s = Segments.open(spark, str(tmp_path / "c"))

    def more(s, names):
        s = s.register(paths(spark, *names))
        ids = {r["name"]: r.id for r in s.documents.collect()}
        rows = [((ids[n] << 20) + i, ids[n], i, [], 1, "m", f"text {n}") for n in names for i in range(2)]
        return s.put_chunks(spark.createDataFrame(rows, TABLES["chunks"]), spark.createDataFrame([(r[0], r[1], unit()) for r in rows], TABLES["vectors"]))

    s = more(s, [f"d{i}" for i in range(150)])
    assert s.index_vectors(least=10**6).head.vectors == ()
    s = s.index_vectors()
    q, wide = unit(), 10**6
    exact = lambda s: [r.id for r in vectors.knn(s.rows("vectors"), q, 500, "chunk_id", "vector").collect()]
    near = lambda s: [r.id for r in s.near(q, 500).collect()]
    ann.VectorIndex.read(spark, f"{s.path}/ann/{s.head.vectors[0]['name']}")
    old = ann.VectorIndex.search
    ann.VectorIndex.search = lambda self, v, k, dead=None: old(self, v, k, probes=wide, width=ann.PART_ROWS, dead=dead)
    try:
        assert near(s) == exact(s) and len(near(s)) == 300
        s = more(s, ["d0", "d1", "x", "y"])  # two of them for the second time
        s = s.delete(s.documents.filter("name IN ('d5', 'y')").select("id"))
        assert near(s) == exact(s) and len(near(s)) == 300
        merged = s.merge(list(s.head.segments))
        assert near(merged) == exact(merged) == exact(s)
        merged.vacuum(1)
        assert near(merged.index_vectors()) == exact(merged)
    finally:
        ann.VectorIndex.search = old
    assert indexing.Corpus.read(spark, s.path).search("text", embed=lambda t: F.array(*[F.lit(float(x)) for x in q])).count() == 20


def test_upload_in_one_call(spark, tmp_path):
    """Below the threshold files wait; then all that wait are indexed in one call."""
    folder, path, config = str(tmp_path / "files"), str(tmp_path / "c"), Config(reindex_threshold=3)
    up = lambda *files: indexing.upload(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in files], "path string, content binary"), folder, path, config)
    corpus, outcome, _ = up(("/x/a.md", "# Ponds\n\nStill water."), ("/x/b.txt", "Running water."))
    assert outcome == {"uploaded": 2, "indexed_now": False, "pending_before": 2, "pending_after": 2, "threshold": 3, "reindexed_count": 0}
    assert corpus.search("water").isEmpty()
    corpus, outcome, errors = up(("/x/c.docx", "no zip"))
    assert outcome == {"uploaded": 1, "indexed_now": True, "pending_before": 3, "pending_after": 1, "threshold": 3, "reindexed_count": 2}
    assert [r.error.split(":")[0] for r in errors.collect()] == ["BadZipFile"]
    assert {r.document_name for r in corpus.search("water").collect()} == {"a.md", "b.txt"}
    with pytest.raises(ValueError):
        up(("/x/d.txt", "fine"), ("/x/e.exe", "no"))
    assert indexing.Corpus.read(spark, path).store.documents.count() == 3


def test_pending_in_order(spark):
    d = spark.createDataFrame([(3, False), (1, False), (2, True)], "id long, is_indexed boolean").repartition(3)
    assert [r.id for r in store.pending(d).collect()] == [1, 3]


def test_parsers_read_some_files(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    assert parsers.read_files(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/c.txt"]).count() == 2
    with pytest.raises(FileNotFoundError):
        parsers.read_files(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/z.txt"])


def test_a_cut_through_equal_scores(spark, tmp_path):
    """More documents of one score than corpus_after_changes keeps: those of the smallest numbers stay, not those whose paths come first."""
    n = 100_050
    spark.range(1, n + 1).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'and' WHEN id % 1000 = 1 THEN 'the and and' ELSE 'the and so' END AS text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(n + 1, n + 201).selectExpr("id AS doc_id", "'the and so' AS text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["corpus_after_changes"](spark, str(tmp_path)).toPandas()
    sql = catalog.oracle_sql()["corpus_after_changes"]
    for t in ("documents", "labels"):
        sql = sql.replace(f"FROM {t} ", f"FROM '{tmp_path}/{t}.parquet/*.parquet' ")
    want = duckdb.sql(sql).df()
    assert len(got) == 100_000 and set(got["document_path"]) == set(want["document_path"])
