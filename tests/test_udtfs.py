"""Table functions of SQL: from files to blocks to pieces in one text."""

import pytest
from pyspark.errors import PySparkException

from docquarry.operators import chunking
from docquarry.sources import parsers, udtfs


@pytest.fixture(scope="module")
def sql(spark):
    udtfs.register(spark)
    return spark.sql


def test_files_to_blocks_like_parse_files(spark, sql, tmp_path):
    (tmp_path / "a.md").write_text("# Ponds\n\nStill water.\n\n- one\n- two\n")
    (tmp_path / "b.html").write_text("<h1>Rivers</h1><p>Run<p>cold<pre><code class=language-py>x")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    parsers.read_files(spark, str(tmp_path)).createOrReplaceTempView("some_files")
    rows = sql("SELECT f.path, b.* FROM some_files f, LATERAL parse_blocks(f.content, f.kind) b").collect()
    want = parsers.get_blocks(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.position, r.type, r.text, r.level, r.language) for r in rows if r.error is None) == sorted((r.id, r.position, r.type, r.text, r.level, r.metadata.language if r.metadata else None) for r in want)
    assert [r.error.split(":")[0] for r in rows if r.error] == ["BadZipFile"]
    pieces = sql("SELECT p.* FROM some_files f, LATERAL parse_blocks(f.content, f.kind) b, LATERAL split_text(b.text, b.type, 2) p WHERE b.type = 'list'").collect()
    assert [(p.piece, p.text, p.tokens) for p in pieces] == [(0, "- one", 2), (1, "- two", 2)]


def test_null_and_empty(sql):
    assert sql("SELECT * FROM parse_blocks(CAST(NULL AS STRING), 'txt')").count() == 0 and sql("SELECT * FROM parse_blocks('', 'html')").count() == 0
    assert sql("SELECT * FROM split_text(CAST(NULL AS STRING), 'paragraph', 3)").count() == 0
    assert [r.text for r in sql("SELECT * FROM split_text('a b c d', 'code', 3)").collect()] == chunking.DEFAULT.split_block("a b c d", "code", 3)


@pytest.mark.parametrize("call", ["parse_blocks(1, 'txt')", "parse_blocks('x', 'odt')", "split_text('x', 'code', 0)", "split_text('x', 'code', 'y')"])
def test_refused_when_analyzed(sql, call):
    with pytest.raises(PySparkException):
        sql(f"SELECT * FROM {call}")
