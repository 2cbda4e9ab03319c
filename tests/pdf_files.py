"""A small writer of PDF files for tests: text at places, rules, several ways to store objects."""

import zlib


class Pdf:
    def __init__(self, compress=True, objects_in_stream=False):
        self.pages, self.compress, self.packed = [[]], compress, objects_in_stream

    def text(self, x, y, said, size=11.0, font="F1"):
        raw = said.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        self.pages[-1].append(b"BT /%s %.1f Tf %.2f %.2f Td (%s) Tj ET" % (font.encode(), size, x, 842 - y, raw))

    def line(self, x0, y0, x1, y1):
        self.pages[-1].append(b"%.2f %.2f m %.2f %.2f l S" % (x0, 842 - y0, x1, 842 - y1))

    def raw(self, body):
        self.pages[-1].append(body)

    def page(self):
        self.pages.append([])

    def build(self, broken=False):
        n = len(self.pages)
        objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
        objects[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"
        objects[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding << /Differences [65 /B /uni00E9 /comma] >> >>"
        kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n))
        objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> >> >>" % (n, kids)
        streams = {}
        for i, parts in enumerate(self.pages):
            objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
            body = b"\n".join(parts)
            streams[11 + 2 * i] = (b"/Filter /FlateDecode ", zlib.compress(body)) if self.compress else (b"", body)
        out, places = bytearray(b"%PDF-1.5\n"), {}
        put = lambda k, body: (places.__setitem__(k, len(out)), out.extend(b"%d 0 obj\n%s\nendobj\n" % (k, body)))
        for k, (how, body) in streams.items():
            put(k, b"<< %s/Length %d >>\nstream\n%s\nendstream" % (how, len(body), body))
        if not self.packed:
            for k, body in objects.items():
                put(k, body)
            start, last = len(out), max(places)
            out += b"xref\n0 %d\n0000000000 65535 f \n" % (last + 1)
            out += b"".join(b"%010d 00000 n \n" % places[k] if k in places else b"0000000000 00000 f \n" for k in range(1, last + 1))
            out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (last + 1, 7 if broken else start)
            return bytes(out)
        keys, bodies = list(objects), list(objects.values())
        starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
        head = b" ".join(b"%d %d" % x for x in zip(keys, starts)) + b" "
        body = zlib.compress(head + b" ".join(bodies))
        put(90, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(keys), len(head), len(body), body))
        rows = []
        for k in range(92):
            kind, a, b = (2, 90, keys.index(k)) if k in objects else (1, places.get(k, len(out)), 0) if k in places or k == 91 else (0, 0, 0)
            rows.append(bytes([kind]) + a.to_bytes(4) + b.to_bytes(1))
        before, coded = bytes(6), bytearray()
        for r in rows:  # each row as the difference to the one above
            coded += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before))
            before = r
        table, start = zlib.compress(bytes(coded)), len(out)
        put(91, b"<< /Type /XRef /Size 92 /W [1 4 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d >>\nstream\n%s\nendstream" % (len(table), table))
        return bytes(out) + b"startxref\n%d\n%%%%EOF" % (7 if broken else start)


TABLE = [["Framework", "Type", "First Release"], ["Flask", "Micro", "2010"], ["Django", "Full", "2005"], ["FastAPI", "Async", "2018"]]


def sample(**how):
    """A page of headings of three sizes, body text, a drawn table, a list and code."""
    p, y = Pdf(**how), 60.0

    def put(text, size=11.0, font="F1"):
        nonlocal y
        p.text(60, y, text, size, font)
        y += size * 1.5

    put("Python Web Frameworks", 22)
    y += 15
    put("Introduction", 16)
    for s in ("Web frameworks are software libraries for the development", "of web applications, services and resources.", "They handle routing, templates and logins."):
        put(s)
    y += 15
    put("Flask", 14)
    put("Flask is a small framework that makes a start easy.")
    y += 15
    put("Comparison", 16)
    for r in range(5):
        p.line(60, y + 18 * r, 450, y + 18 * r)
    for c in range(4):
        p.line(60 + 130 * c, y, 60 + 130 * c, y + 72)
    for r, row in enumerate(TABLE):
        for c, cell in enumerate(row):
            p.text(64 + 130 * c, y + 18 * r + 13, cell, 10)
    y += 102
    put("Key Features", 16)
    for s in ("- URL routing", "- Templates"):
        put(s)
    y += 15
    put("Code Example", 16)
    for s in ("def hello():", '    return "Hello, World!" # (escaped \\)'):
        put(s, 8, "F2")
    return p.build()
