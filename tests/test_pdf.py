"""PDF files from bytes to blocks, and ruled tables against a brute-force version."""

import random
import zlib

import numpy as np
import pytest

from docquarry.operators import pdf_layout
from docquarry.sources import parsers, pdf
from tests.pdf_files import TABLE, Pdf, sample


def shown(raw):
    return [i[3] for i in pdf.items(raw) if i[2] == "run"]


@pytest.mark.parametrize("broken", [False, True])
@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_every_way_to_store_objects(broken, compress, packed):
    p = Pdf(compress, packed)
    p.text(60, 60, "Hello (world) \\ ü")
    p.page()
    p.text(60, 60, "second")
    got = pdf.items(p.build(broken))
    assert [(i[0], i[3]) for i in got] == [(1, "Hello (world) \\ ü"), (2, "second")]
    assert got[0][4:6] == (11.0, 0) and got[0][6] == 60.0 and got[0][7] < 60 < got[0][9]


def test_text_state():
    p = Pdf()
    p.raw(rb"BT /F1 10 Tf 14 TL 1 0 0 1 100 700 Tm (a) Tj T* (b) Tj (c) ' 5 -20 TD [(d) -500 (e) 20 (f)] TJ <6768> Tj 2 0 0 2 50 500 Tm (big) Tj ET")
    p.raw(rb"q 0.5 0 0 0.5 10 10 cm BT /F1 20 Tf (half) Tj ET Q BT /F3 10 Tf (AB,) Tj ET (\101\x \(\
z) pop BT /F1 9 Tf (\101\)\050\n) Tj ET")
    got = [i for i in pdf.items(p.build()) if i[2] == "run"]
    assert [i[3] for i in got] == ["a", "b", "c", "d ef", "gh", "big", "half", "Bé,", "A)(\n"]
    assert [i[4] for i in got] == [10, 10, 10, 10, 10, 20, 10, 10, 9] and [i[5] for i in got] == [0] * 7 + [16, 0]
    base = [round(842 - (i[9] - 0.2 * i[4]), 3) for i in got]
    assert base[:6] == [700, 686, 672, 652, 652, 500] and base[6] == 10 and got[6][6] == 10.0
    assert [round(i[6], 1) for i in got[:4]] == [100, 100, 100, 105]


def test_character_maps():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <00480065> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059>] endbfrange"
    assert pdf._unicode_map(cmap) == {b"\0\1": "He", b"\0\2": "😀", b"\0\x10": "a", b"\0\x11": "b", b"\0\x12": "c", b"\0\x20": "X", b"\0\x21": "Y"}
    body = zlib.compress(b"BT /T 10 Tf 10 10 Td <000100100021> Tj ET")
    raw = b"%%PDF-1.4 1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Contents 4 0 R/Resources<</Font<</T<</Subtype/Type0/DescendantFonts[<</W[1[2000] 16 17 500]/DW 100>>]/ToUnicode 5 0 R>>>>>>>> endobj"
    raw += b" 4 0 obj <</Filter/FlateDecode>> stream\n%s\nendstream endobj 5 0 obj <<>> stream\n%s\nendstream endobj" % (body, cmap)
    (item,) = pdf.items(raw)
    assert item[3] == "HeaY" and round(item[8] - item[6], 6) == 10 * (2.0 + 0.5 + 0.1)


def test_forms_rules_and_curves():
    p = Pdf()
    p.raw(b"10 10 100 50 re S 0 0 m 5 5 l S 20 20 1 200 re f 0 0 40 40 re f 1 1 m 9 9 9 9 1 9 c S 5 5 m 50 5 l n")
    rules = [i[6:] for i in pdf.items(p.build()) if i[2] == "rule"]
    assert len(rules) == 5 and (20.5, 842 - 220, 20.5, 842 - 20) in rules


@pytest.mark.parametrize("raw", [b"", b"junk", b"%PDF-1.4\ntrailer <</Root 7 0 R>>", b"\x00" * 100])
def test_no_pdf(spark, raw):
    files = spark.createDataFrame([("x", bytearray(raw)), ("y", bytearray(sample()))], "path string, content binary")
    got = pdf.read_items(files).groupBy("doc").count().collect()
    assert {r.doc for r in got} == {"x", "y"}
    assert pdf.read_items(files).filter("error IS NOT NULL").select("doc").collect()[0].doc == "x"


def test_encrypted():
    raw = sample(compress=False).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.items(raw)


def test_sample_file(spark, tmp_path):
    """What the file's own layout says: headings by size, one table, paragraphs, a page for every block."""
    (tmp_path / "sample.pdf").write_bytes(sample())
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "note.txt").write_text("a note")
    blocks = sorted(parsers.get_blocks(spark, str(tmp_path)).filter("id LIKE '%sample.pdf'").collect(), key=lambda r: r.position)
    assert [r.position for r in blocks] == list(range(len(blocks)))
    headings = [(r.level, r.text) for r in blocks if r.type == "heading"]
    assert headings == [(1, "Python Web Frameworks"), (2, "Introduction"), (3, "Flask"), (2, "Comparison"), (2, "Key Features"), (2, "Code Example")]
    assert [r.text for r in blocks if r.type == "table"] == ["\n".join(" | ".join(row) for row in TABLE)]
    assert sum(r.type == "paragraph" for r in blocks) == 4 and all(r.metadata.page == 1 for r in blocks)
    assert [r.path.rsplit("/", 1)[1] for r in parsers.problems(spark, str(tmp_path)).collect()] == ["bad.pdf"]


def random_grid(rng):
    """(rules, boxes): a grid with some of its squares merged to rectangles; rules in pieces, a little off, in any order."""
    rows, cols = rng.randint(1, 5), rng.randint(1, 5)
    xs = np.cumsum([rng.randint(20, 60) for _ in range(cols + 1)]).astype(float)
    ys = np.cumsum([rng.randint(12, 40) for _ in range(rows + 1)]).astype(float)
    owner = np.arange(rows * cols).reshape(rows, cols)
    for _ in range(rng.randint(0, 3)):
        r, c = rng.randrange(rows), rng.randrange(cols)
        r2, c2 = rng.randint(r, min(rows - 1, r + 1)), rng.randint(c, min(cols - 1, c + 2))
        inside = owner[r : r2 + 1, c : c2 + 1]
        if all((owner == k).sum() == 1 for k in np.unique(inside)):
            owner[r : r2 + 1, c : c2 + 1] = inside.min()
    off, rules = lambda: rng.uniform(-0.7, 0.7), []
    for r in range(rows + 1):
        for c in range(cols):
            if r in (0, rows) or owner[r - 1, c] != owner[r, c]:
                rules.append((xs[c] + off(), ys[r] + off(), xs[c + 1] + off(), ys[r] + off()))
    for c in range(cols + 1):
        for r in range(rows):
            if c in (0, cols) or owner[r, c - 1] != owner[r, c]:
                rules.append((xs[c] + off(), ys[r] + off(), xs[c] + off(), ys[r + 1] + off()))
    boxes = set()
    for k in np.unique(owner):
        i, j = np.nonzero(owner == k)
        boxes.add((xs[j.min()], ys[i.min()], xs[j.max() + 1], ys[i.max() + 1]))
    rng.shuffle(rules)
    return np.array(rules), boxes


@pytest.mark.parametrize("seed", range(60))
def test_grids_like_brute_force(seed):
    rules, boxes = random_grid(random.Random(seed))
    got = pdf_layout.grid_cells(rules)
    if len(boxes) < 2:
        assert got == []
        return
    near = lambda a, b: all(abs(x - y) < 2 for x, y in zip(a, b))
    assert len(got) == len(boxes) and all(any(near(g[3:], b) for b in boxes) for g in got)
    assert {g[0] for g in got} == {0} and len({g[1:3] for g in got}) == len(got)


def test_two_tables_and_loose_rules():
    grid = lambda x, y: [(x, y + 20 * k, x + 80, y + 20 * k) for k in range(3)] + [(x + 40 * k, y, x + 40 * k, y + 40) for k in range(3)]
    loose = [(300.0, 10.0, 400.0, 10.0), (500.0, 10.0, 500.0, 300.0)]
    open_ = [(300.0, 400.0, 380.0, 400.0), (300.0, 400.0, 300.0, 440.0), (340.0, 400.0, 340.0, 440.0)]  # no rule below or right
    got = pdf_layout.grid_cells(np.array(grid(10, 200) + grid(10, 50) + loose + open_, float))
    assert [(g[0], g[4]) for g in got if g[1] == g[2] == 0] == [(0, 50.0), (1, 200.0)] and len(got) == 8
