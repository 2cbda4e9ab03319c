"""Parsers, breadcrumbs and chunking on small files of our own."""

import io
import zipfile

import duckdb
import pytest

from docquarry.operators import breadcrumbs, chunking
from docquarry.plans import catalog
from docquarry.sources import parsers

TXT = """# Guide to Ponds

## Water

Still water warms
in the sun.

Setext
======

- frogs
- newts
  and more

| a | b |
|---|---|
| 1 | 2 |

```python
# not a heading
x = 1
```

### Deep ###

Last paragraph.
"""

HTML = """<html><head><title>t</title></head><body><nav><p>menu</p></nav><h1>Guide</h1><div>bare<p>One <b>bold</b> word<p>Two</div>
<ul><li>a<ol><li>b</li></ol></li><li>c</ul><table><tr><th>x<th>y<tr><td>1<td>2</table><pre><code class="hl language-py">a
 b</code></pre><figure><figcaption>Fig</figcaption></figure><script>no()</script></body></html>"""

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(parts):
    body = ""
    for style, text in parts:
        if style == "table":
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in text) + "</w:tbl>"
        else:
            body += f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{_W}"><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style></w:styles>')
    return out.getvalue()


def kinds(blocks):
    return [(b["type"], b["level"]) for b in blocks]


def test_txt():
    b = parsers.parse_txt(TXT)
    assert kinds(b) == [("heading", 1), ("heading", 2), ("paragraph", None), ("heading", 1), ("list", None), ("paragraph", None), ("code", None), ("heading", 3), ("paragraph", None)]
    assert [x["position"] for x in b] == list(range(len(b)))
    assert b[6]["metadata"]["language"] == "python" and b[6]["text"] == "# not a heading\nx = 1"
    assert b[7]["text"] == "Deep" and b[4]["text"] == "- frogs\n- newts\n  and more"


@pytest.mark.parametrize("text, want", [("", []), ("\n \n", []), ("```\nx", [("code", None)]), ("- a\n---", [("heading", 2)]), ("a\nb\n===", [("paragraph", None), ("heading", 1)])])
def test_txt_edges(text, want):
    assert kinds(parsers.parse_txt(text)) == want


def test_html():
    b = parsers.parse_html(HTML)
    assert [(x["type"], x["text"]) for x in b] == [
        ("heading", "Guide"), ("paragraph", "One bold word"), ("paragraph", "Two"), ("list", "- a\n  - b\n- c"), ("table", "x | y\n1 | 2"), ("code", "a\n b"), ("caption", "Fig"),
    ]
    assert b[5]["metadata"]["language"] == "py"


def test_docx():
    b = parsers.parse_docx(docx([("H2", "Head"), ("Code", "a"), ("Code", " "), ("Code", "b"), ("ListBullet", "i"), ("ListBullet", "j"), ("Normal", "p"), ("table", [["1", "2"], ["1", "2"], ["3", "4"]])]))
    assert [(x["type"], x["text"]) for x in b] == [("heading", "Head"), ("code", "a\nb"), ("list", "- i\n- j"), ("paragraph", "p"), ("table", "1 | 2\n3 | 4")]
    assert b[0]["level"] == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.MD").write_text(TXT)
    (tmp_path / "b.html").write_text(HTML)
    (tmp_path / "c.docx").write_bytes(docx([("Normal", "p")]))
    (tmp_path / "d.odt").write_text("x")
    got = {r.id.rsplit("/", 1)[1]: r["count"] for r in parsers.get_blocks(spark, str(tmp_path)).groupBy("id").count().collect()}
    assert got == {"a.MD": 9, "b.html": 7, "c.docx": 1}
    assert [r.error for r in parsers.unsupported(spark, str(tmp_path)).collect()] == ["Unsupported file type: .odt"]


def test_missing_and_broken_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        parsers.get_blocks(spark, str(tmp_path / "none"))
    (tmp_path / "a.docx").write_bytes(b"PK broken")
    (tmp_path / "b.txt").write_text("fine")
    assert [r.text for r in parsers.get_blocks(spark, str(tmp_path)).collect()] == ["fine"]
    assert [r.error.split(":")[0] for r in parsers.problems(spark, str(tmp_path)).collect()] == ["BadZipFile"]


@pytest.mark.parametrize("line, want", [("# a #", (1, "a")), ("###### b", (6, "b")), ("####### c", None), ("#d", None), ("# #", (1, "#")), ("## e #f", (2, "e #f")), ("#\tg  ## ", (1, "g"))])
def test_heading_lines(line, want):
    assert parsers.atx(line) == want


@pytest.mark.parametrize("line, want", [("- a", True), ("-a", False), ("  12. b", True), ("12) c", False), ("+ ", False), ("*", False), ("1.x", False), ("\t* d", True)])
def test_item_lines(line, want):
    assert parsers.item(line) is want


@pytest.mark.parametrize("line, want", [("```py x", ("```", "py")), ("~~~~", ("~~~~", "")), ("``` py", ("```", "")), ("``", None), (" ```", None)])
def test_fence_lines(line, want):
    assert parsers.fence(line) == want


def crumbs(rows):
    """Reference rule: a heading replaces its level and ends deeper ones."""
    out, live = [], {}
    for kind, level, text in rows:
        if kind == "heading":
            live = {k: v for k, v in live.items() if k < level}
            out.append([live[k] for k in sorted(live)])
            live[level] = text
        else:
            out.append([live[k] for k in sorted(live)])
    return out


def test_breadcrumbs(spark):
    rows = [("paragraph", None, "p")] + [("heading", lv, f"h{i}") if lv else ("paragraph", None, "x") for i, lv in enumerate([1, 2, 0, 4, 0, 3, 0, 2, 0, 1, 0, 6, 0, 5, 0, 2, 3, 0])]
    df = spark.createDataFrame([(1, i, k, t, lv) for i, (k, lv, t) in enumerate(rows)], "id long, position int, type string, text string, level int")
    got = [r.breadcrumbs for r in breadcrumbs.breadcrumbs(df).orderBy("position").collect()]
    assert got == crumbs(rows)


@pytest.mark.parametrize("kind", ["paragraph", "list", "table", "code"])
def test_splits_fit_and_keep_text(kind):
    text = "\n".join(f"Sentence {i} has; several, parts: and more words." * (1 + i % 3) for i in range(30)) + "\n" + "w " * 200
    parts = chunking.DEFAULT.split_block(text, kind, 40)
    assert all(chunking.DEFAULT.count(p) <= 40 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_table_header_repeats():
    rows = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | some cell text |" for i in range(30))
    parts = chunking.DEFAULT.split_rows(rows, 40)
    assert len(parts) > 2 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts)


def test_chunks(spark):
    text = "# T\n\n" + "\n\n".join("word " * 150 + f"end{i}." for i in range(8)) + "\n\n## Alone\n"
    blocks = parsers.parse_txt(text)
    for b, c in zip(blocks, crumbs([(b["type"], b["level"], b["text"]) for b in blocks])):
        b["breadcrumbs"] = c
    out = chunking.DEFAULT.build_chunks(blocks)
    assert [c["position"] for c in out] == list(range(len(out)))
    assert out[-1]["text"].endswith("Alone") and out[-1]["breadcrumbs"] == ["T", "Alone"]
    assert all(chunking.DEFAULT.count(c["embedding_input"]) <= chunking.MODEL_MAX for c in out)
    assert chunking.budget() == (338, 512)
    assert chunking.DEFAULT.build_chunks([{"type": "heading", "level": 1, "text": "h", "breadcrumbs": []}, {"type": "paragraph", "level": None, "text": " ", "breadcrumbs": []}]) == []


def test_references_without_a_semicolon_in_titles(spark, tmp_path):
    """They are text in html_headings, as in its twin; the parser itself reads them as browsers do."""
    pages = [(1, "u", "<body><h1>a &amp; b &amp</h1><p>x"), (2, "u", "<body><h1>&&&lt;i&gt; &quot</h1>"), (3, "u", "<body><h1>R&D & more &amp;lt;</h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.id: r.text for r in catalog.queries()["html_headings"](spark, str(tmp_path)).collect()}
    want = duckdb.sql(catalog.oracle_sql()["html_headings"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert got == {1: "a & b &amp", 2: "&&<i> &quot", 3: "R&D & more &lt;"} == dict(want)
    assert parsers.parse_html("<h1>a &amp</h1>")[0]["text"] == "a &"
