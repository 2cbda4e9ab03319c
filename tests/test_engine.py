"""Text search, vectors, store, streams and settings."""

import sqlite3

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import access, chunking, fts, fusion, indexing, pdf_spans, search, store, vectors
from docquarry.plans import catalog, schemas
from docquarry.sources import corpora, parsers
from docquarry.streaming import threshold

TEXTS = ["the cat sat on the mat", "cats and dogs", "élan vital: the CAT's élan", "don't stop", "do not stop the cat", "", "dog dog dog cat", "the the the"]


def fts5(query):
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    c.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(TEXTS)))
    q = " ".join(f'"{w}"' for w in "".join(" " if ch in X.QUERY_SYNTAX else ch for ch in query).split())
    return c.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid", (q,)).fetchall()


@pytest.fixture(scope="module")
def index(spark):
    return fts.build_index(spark.createDataFrame([Row(id=i, text=t) for i, t in enumerate(TEXTS)]))


@pytest.mark.parametrize("query", ["cat", "the cat", "don't", "elan", "the the", "stop cat", "dog", "absent", "cat-the"])
def test_bm25_like_fts5(index, query):
    got = [(r.id, r.score) for r in fts.bm25(index, query).collect()]
    want = fts5(query)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))


@pytest.mark.parametrize("query", ["", "   ", "!!!", '"*"', None])
def test_no_words_no_hits(index, query):
    assert fts.bm25(index, query).count() == 0


def test_refresh_index(spark, index):
    new = fts.refresh_index(index, spark.createDataFrame([Row(id=0, text="zebra")]), spark.createDataFrame([Row(id=1)]))
    assert [r.id for r in fts.bm25(new, "zebra").collect()] == [0]
    assert fts.bm25(new, "cats").count() == 0 and new.lengths.count() == len(TEXTS) - 1


def test_knn_needs_k(spark, sf):
    with pytest.raises(ValueError):
        vectors.knn(spark.read.parquet(f"{sf}/embeddings.parquet"), [1.0], 0)


def test_batch_knn_in_blocks(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id % 100 = 0")
    one = vectors.knn_batch(v, q, 5).collect()
    assert sorted(one) == sorted(vectors.knn_batch(v, q, 5, most_bytes=600).collect())


def test_zero_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.id for r in vectors.knn(v, [1.0, 0.0], 5).collect()] == [2]


def test_hashed_embedding_is_unit(spark):
    d = spark.createDataFrame([("the cat",), ("",), (None,)], "t string").select(vectors.hashed_embedding(F.col("t")).alias("v")).select(vectors.norm(F.col("v")).alias("n"))
    assert [round(r.n, 9) for r in d.collect()] == [1.0, 0.0, 0.0]


def test_fusion_ties(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    f = spark.createDataFrame([(3, 1), (2, 2)], "id long, rank long")
    got = [(r.id, r.rrf_rank) for r in fusion.reciprocal_rank_fusion(v, f).orderBy("rrf_rank").collect()]
    assert got == [(2, 1), (1, 2), (3, 3)]


def test_blank_search(spark, index):
    empty = spark.createDataFrame([], "id long, document_id long, breadcrumbs array<string>, raw_text string")
    assert search.search("  ", [1.0], index, None, empty, None).count() == 0
    with pytest.raises(ValueError):
        fusion.rerank(empty.withColumn("rrf_rank", F.lit(1)), "x", 0)


def make_store(spark):
    docs = spark.createDataFrame([(1, "/a", "a", True), (2, "/b", "b", False)], schemas.DOCUMENTS)
    chunks = spark.createDataFrame([(10, 1, 0, ["x"], 1, "m", "t"), (11, 2, 0, [], 1, "m", "u")], schemas.CHUNKS)
    vecs = spark.createDataFrame([(10, 1, [1.0]), (11, 2, [2.0])], schemas.VECTORS)
    return store.Store(docs, chunks, vecs)


def test_store_cycle(spark):
    s = make_store(spark)
    gone = s.delete(spark.createDataFrame([(1,)], "id long"))
    assert [t.count() for t in (gone.documents, gone.chunks, gone.vectors)] == [1, 1, 1]
    again = s.register(spark.createDataFrame([("/a", "new a"), ("/c", "c")], "document_path string, name string"))
    assert again.documents.count() == 3 and again.chunks.count() == 1
    new = s.put_chunks(spark.createDataFrame([(12, 2, 0, [], 1, "m", "v"), (13, 2, 1, [], 1, "m", "w")], schemas.CHUNKS), spark.createDataFrame([(12, 2, [3.0])], schemas.VECTORS))
    assert new.chunks.count() == 3 and new.vectors.count() == 2 and new.documents.filter("is_indexed").count() == 2
    schemas.verify_schema(new.documents, schemas.DOCUMENTS)
    with pytest.raises(ValueError):
        schemas.verify_schema(new.documents, schemas.CHUNKS)


def test_paging_bounds(spark):
    with pytest.raises(ValueError):
        store.page(make_store(spark).documents, -1, 5)
    assert [r.id for r in store.page(make_store(spark).documents, 1, 5).collect()] == [2]


def test_batches(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([30, 30, 30, 30, 250, 1])], "doc_id long, chunks long")
    assert [r.batch for r in store.batches_by_document(d, 100).orderBy("doc_id").collect()] == [0, 0, 0, 1, 2, 3]


def test_threshold_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(4).write.parquet(src)
    schema = spark.range(1).schema
    threshold.run(spark, src, schema, str(tmp_path / "st"), 10).awaitTermination()
    assert threshold.latest(spark, str(tmp_path / "st")).filter("is_indexed").count() == 0
    spark.range(4, 11).coalesce(1).write.mode("append").parquet(src)
    threshold.run(spark, src, schema, str(tmp_path / "st"), 10).awaitTermination()
    assert threshold.latest(spark, str(tmp_path / "st")).filter("is_indexed").count() == 11


def test_threshold_hands_over_pending(spark, tmp_path):
    src, calls = str(tmp_path / "in"), []
    for lo, hi in ((0, 6), (6, 11), (11, 13)):
        spark.range(lo, hi).coalesce(1).write.mode("append").parquet(src)
        threshold.run(spark, src, spark.range(1).schema, str(tmp_path / "st"), 10, index=lambda df, b: calls.append(sorted(r.id for r in df.collect()))).awaitTermination()
    assert calls == [list(range(11))]
    rows = threshold.latest(spark, str(tmp_path / "st"))
    assert rows.count() == 13 and rows.filter("is_indexed").count() == 11


def test_delta(spark):
    main, delta = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), spark.createDataFrame([(2, "c")], "id long, x string")
    assert sorted(map(tuple, threshold.with_delta(main, delta).collect())) == [(1, "a"), (2, "c")]


def test_pdf_blocks(spark):
    spans = [
        ("d", 1, 0, 0, 0, 22.0, 0, "Title", 0.0, 0.0, 9.0, 9.0), ("d", 1, 1, 0, 0, 11.0, 0, "body", 0.0, 20.0, 9.0, 29.0), ("d", 1, 1, 0, 1, 11.0, 0, "text", 9.0, 20.0, 19.0, 29.0),
        ("d", 1, 2, 0, 0, 11.0, 0, "cell", 0.0, 41.0, 9.0, 45.0), ("d", 1, 3, 0, 0, 11.0, 16, "Bold", 0.0, 60.0, 9.0, 69.0),
    ]
    s = spark.createDataFrame(spans, "doc string, page int, block int, line int, seq int, size double, flags int, text string, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("d", 1, 0, "cell | x", 0.0, 40.0, 50.0, 50.0)], "doc string, page int, tab int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.type, r.text, r.level) for r in pdf_spans.blocks(s, t).orderBy("position").collect()]
    assert got == [("heading", "Title", 1), ("paragraph", "body text", None), ("table", "cell | x", None), ("heading", "Bold", 5)]


def test_access_and_settings(spark, tmp_path):
    r = spark.range(1).select(access.check_permission(F.lit(3), 3).alias("a"), access.check_permission(F.lit(1), 3).alias("b"), access.hash_password(F.lit("p"), F.lit("s")).alias("h")).first()
    assert (r.a, r.b, len(r.h)) == (True, False, 64)
    (tmp_path / "c.ini").write_text("[x]\nchunk_tokens = 7\n")
    assert corpora.Config.read(str(tmp_path / "c.ini")) == corpora.Config(chunk_tokens=7)


def test_cached_corpus(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(f"/{i}", "t") for i in range(5)], "document_path string, text string")

    for _ in range(2):
        assert [r.document_path for r in corpora.cached(spark, str(tmp_path / "c"), 3, make).collect()] == ["/0", "/1", "/2"]
    assert len(made) == 1


def test_new_ids(spark):
    """A document that is registered again has an id that nothing ever had."""
    s = make_store(spark)
    paths = spark.createDataFrame([("/a", "x")], "document_path string, name string")
    one = s.register(paths)
    two = one.register(paths)
    ids = [t.documents.filter("document_path = '/a'").first().id for t in (s, one, two)]
    assert len(set(ids)) == 3 and ids[1] > 2


def test_document_without_chunks_is_indexed(spark):
    s = make_store(spark)
    done = s.put_chunks(s.chunks.limit(0), s.vectors.limit(0), spark.createDataFrame([(2,)], "id long"))
    assert [r.document_id for r in done.chunks.collect()] == [1] and done.documents.filter("is_indexed").count() == 2


@pytest.mark.parametrize("per_range", [7, 1000])
def test_numbering_and_batches_over_ranges(spark, per_range):
    import random

    rng = random.Random(4)
    ids = rng.sample(range(1000), 150)
    sizes = {i: rng.choice([0, 1, 5, 30, 99, 100, 101, 250]) for i in ids}
    d = spark.createDataFrame(sorted(sizes.items(), key=lambda x: rng.random()), "doc_id long, chunks long")
    assert [r.place for r in store.numbered(d, "doc_id", per_range=per_range).orderBy("doc_id").collect()] == list(range(150))
    names = d.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("n"))
    assert [r.n for r in store.numbered(names, "n", per_range=per_range).orderBy("place").collect()] == sorted(f"n{i}" for i in ids)
    want, batch, fill = {}, 0, 0
    for i in sorted(ids):
        if fill > 0 and fill + sizes[i] > 100:
            batch, fill = batch + 1, 0
        fill += sizes[i]
        want[i] = batch
    assert {r.doc_id: r.batch for r in store.batches_by_document(d, 100, per_range=per_range).collect()} == want


def test_upload(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    good = ("/x/a.txt", bytearray(b"one"))
    for bad in ([good, ("/x/b.exe", bytearray(b"z"))], [good, ("/x/b.txt", bytearray(b""))], [(f"/x/{i}.txt", bytearray(b"z")) for i in range(11)]):
        with pytest.raises(ValueError):
            store.upload(files(bad), str(tmp_path / "up"))
        assert not (tmp_path / "up").exists()
    store.upload(files([good]), str(tmp_path / "up"))
    assert (tmp_path / "up" / "a.txt").read_bytes() == b"one"


def test_stored_index(spark, index, tmp_path):
    kept = index.write(str(tmp_path / "i"), buckets=8)
    for query in ("the cat", "don't", "absent", "!!!"):
        assert fts.bm25(kept, query).collect() == fts.bm25(index, query).collect()
    plan = kept.of(["cat"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "IN" not in plan.split("PartitionFilters")[1].split("\n")[0]
    again = fts.refresh_index(kept, spark.createDataFrame([Row(id=0, text="zebra")]), spark.createDataFrame([Row(id=1)]))
    assert [r.id for r in fts.bm25(again, "zebra").collect()] == [0] and fts.bm25(again, "cats").count() == 0


def test_search_without_index(spark, index, tmp_path):
    import shutil

    kept = index.write(str(tmp_path / "i"))
    shutil.rmtree(tmp_path / "i" / "postings")
    assert fts.bm25_or_none(kept, "cat").count() == 0


def test_a_search_fails_with_its_index(spark, index, tmp_path):
    import shutil

    s, kept = make_store(spark), index.write(str(tmp_path / "i"))
    find = lambda: [r.chunk_id for r in search.search("cat", [1.0], kept, s.vectors, s.chunks, s.documents).collect()]
    assert 10 in find()
    shutil.rmtree(tmp_path / "i" / "postings")
    with pytest.raises((PySparkException, Py4JError)):
        find()


def test_index_folder(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.md").write_text("# Ponds\n\nStill water warms in the sun.\n")
    (src / "b.html").write_text("<body><h1>Rivers</h1><p>Running water is cold.</p></body>")
    (src / "c.docx").write_bytes(b"not a zip file")
    (src / "d.odt").write_text("x")
    (src / "e.txt").write_text(" \n")
    corpus, errors = indexing.index_folder(spark, str(src), out)
    assert {r.document_path.rsplit("/", 1)[1]: r.error.split(":")[0] for r in errors.collect()} == {"c.docx": "BadZipFile", "d.odt": "Unsupported file type"}
    s = corpus.store
    assert {r.name: r.is_indexed for r in s.documents.collect()} == {"a.md": True, "b.html": True, "c.docx": False, "d.odt": False, "e.txt": True}
    assert s.chunks.count() == s.vectors.count() == 2
    schemas.verify_schema(s.chunks, schemas.CHUNKS), schemas.verify_schema(s.vectors, schemas.VECTORS)
    hits = indexing.Corpus.read(spark, out).search("still water").collect()
    assert hits[0].document_name == "a.md" and hits[0].breadcrumbs == ["Ponds"] and len(hits) == 2
    assert corpus.search("  ").count() == 0
    # a file that changes is registered anew; its old chunk can not be found any more
    (src / "a.md").write_text("# Ponds\n\nFrogs croak.\n")
    new, _ = indexing.index_files(parsers.read_files(spark, str(src / "a.md")), out)
    assert fts.bm25(new.index, "sun").count() == 0 and fts.bm25(new.index, "frogs").count() == 1 and fts.bm25(new.index, "cold").count() == 1
    assert new.store.documents.count() == 5 and new.store.chunks.count() == 2


def test_tokenizer_and_sentence_hooks():
    letters = chunking.Chunker(spans=lambda t: [(i, i + 1) for i, ch in enumerate(t) if ch != " "], sentences=lambda t: t.split("/"))
    assert letters.count("ab cd") == 4 and letters.split_block("abcde/fg/hij", "paragraph", 5) == ["abcde", "fg hij"]
    assert letters.split_hard("abcde", 2) == ["ab", "cd", "e"] and letters.overlapped(["abcd", "ef"], 2) == ["abcd", "cd\n\nef"]


def test_connector_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("b", " T ", " x "), ("a", None, "y"), ("c", "", "z")], "_id string, title string, text string")
    assert corpora.export(corpora.connector(rows, 2, "_id"), str(tmp_path / "o")) == 2
    assert {p.name: p.read_text() for p in (tmp_path / "o").iterdir()} == {"a.txt": "y", "b.txt": "# T\n\nx"}


def test_unit_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.normalise(F.col("v")).alias("u"))
    assert [r.u for r in v.collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("text", ["Cafe\u0301 au lait", "tie\u0302\u0301ng Vi\u1ec7t \u1ebf", "a\u0323b", "Stra\u00dfe \u00d8re", "\u0130stanbul", "o\u0308ne-two_three", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", "\u0439\u043e\u0433", "x\u20d0y", "\u017ft", "\u1e0d\u0121"])
def test_tokens_like_fts5(spark, text):
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    c.execute("INSERT INTO t(x) VALUES (?)", (text,))
    want = [r[0] for r in c.execute("SELECT term FROM v ORDER BY offset")]
    assert X.tokens_python(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("x")).first().x == want


def test_long_table_rows():
    c = chunking.Chunker()
    long = "| " + "word " * 30 + "|"
    top = "| a | b |\n|::  |"
    assert c.split_rows(f"{top}\n| 1 | 2 |\n{long}\n\n| 3 | 4 |\n| 5 | 6 |", 25) == [f"{top}\n| 1 | 2 |", f"{top}\n{long}", f"{top}\n| 3 | 4 |\n| 5 | 6 |"]
    assert c.split_rows(f"{top}\n\n", 4) == c.split_lines(f"{top}\n\n", 4)  # no rows
    assert c.split_rows("| a |\n|\t|\n" + long, 12) == c.split_lines("| a |\n|\t|\n" + long, 12)  # a tab parts nothing
