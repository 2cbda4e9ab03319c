"""The tree of an HTML document, by the public standard's tree construction: implied tags, active formatting, tables with foster parents.

Frames, templates, forms' owners and foreign elements are not told apart, as no block depends on them; tags are cut by the standard library.
"""

from __future__ import annotations

from html.parser import HTMLParser

#: Groups of tags (fixed values of the HTML standard).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD = set("base link meta noscript script style title".split())
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup main menu nav ol p pre listing search section summary ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
MARKING = set("applet marquee object".split())
TABLE_PARTS = set("caption col colgroup tbody td tfoot th thead tr".split())
BODIES, CELLS = {"tbody", "tfoot", "thead"}, {"td", "th"}
IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = BLOCKS | HEADINGS | MARKING | TABLE_PARTS | VOID - {"link"} | HEAD | set("body button dd dt frame frameset head html iframe li noembed noframes plaintext select table template textarea xmp".split())
SCOPE = MARKING | CELLS | {"caption", "html", "table", "template"}
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, {"html", "table", "template"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], None

    def put(self, child, before: "Node | None" = None) -> None:
        if isinstance(child, Node):
            child.cut()
            child.parent = self
        at = len(self.children) if before is None else next(i for i, c in enumerate(self.children) if c is before)
        self.children.insert(at, child)

    def cut(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def walk(self):
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, skip=("script", "style")):
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in skip:
                stack.extend(reversed(c.children))

    def text(self) -> str:
        return " ".join(s for s in (x.strip() for x in self.strings()) if s)


class Tree(HTMLParser):
    """root: the html element; body: its body."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root, self.body, self.foster, self.fresh = Node("html"), None, False, False
        self.head = Node("head")
        self.root.put(self.head)
        self.open, self.active = [self.root], []  # a None in active is a marker
        self.feed(html)
        self.close()
        self._body()

    # -- the stack of open elements

    def _body(self, attrs=()) -> None:
        if self.body is None:
            self.body = Node("body", attrs)
            self.root.put(self.body)
            self.open = [self.root, self.body]

    def _has(self, tags, scope) -> bool:
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in scope:
                return False
        return False

    def _pop_to(self, tags) -> None:
        while self.open.pop().tag not in tags:
            pass

    def _imply(self, keep=()) -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag not in keep:
            self.open.pop()

    def _clear_to(self, tags) -> None:
        while self.open[-1].tag not in tags and self.open[-1].tag != "html":
            self.open.pop()

    def _close_p(self) -> None:
        if self._has({"p"}, BUTTON_SCOPE):
            self._imply({"p"})
            self._pop_to({"p"})

    def _place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Where a node goes: (parent, before).  What does not belong into a table goes before it."""
        target = target or self.open[-1]
        if self.foster and target.tag in BODIES | {"table", "tr"}:
            table = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "table"), None)
            if table is not None:
                t = self.open[table]
                return (t.parent, t) if t.parent is not None else (self.open[table - 1], None)
        return target, None

    def _insert(self, tag: str, attrs=()) -> Node:
        node = Node(tag, attrs)
        parent, before = self._place()
        parent.put(node, before)
        self.open.append(node)
        return node

    # -- active formatting

    def _after_marker(self) -> list:
        out: list = []
        for n in reversed(self.active):
            if n is None:
                break
            out.append(n)
        return out

    def _clear_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _push(self, node: Node) -> None:
        same = [n for n in self._after_marker() if n.tag == node.tag and n.attrs == node.attrs]
        if len(same) >= 3:
            self._forget(same[-1])
        self.active.append(node)

    def _forget(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def _reconstruct(self) -> None:
        """Opens again what formatting was closed by a block's end."""
        i = len(self.active)
        while i and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.open):
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self._insert(old.tag, old.attrs)

    def _adopt(self, tag: str) -> None:
        """The end of formatting, though blocks that began within it are still open."""
        if self.open[-1].tag == tag and not any(n is self.open[-1] for n in self.active):
            self.open.pop()
            return
        for _ in range(8):
            fmt = next((n for n in self._after_marker() if n.tag == tag), None)
            if fmt is None:
                self._other_end(tag)
                return
            at = next((i for i, n in enumerate(self.open) if n is fmt), None)
            if at is None:
                self._forget(fmt)
                return
            if not any(n is fmt for n in self._scoped()):
                return
            block = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self._forget(fmt)
                return
            furthest, ancestor = self.open[block], self.open[at - 1]
            mark = next(i for i, n in enumerate(self.active) if n is fmt)
            last, i, steps = furthest, block, 0
            while self.open[i - 1] is not fmt:
                i, steps = i - 1, steps + 1
                node = self.open[i]
                k = next((j for j, n in enumerate(self.active) if n is node), None)
                if k is not None and steps > 3:
                    del self.active[k]
                    mark, k = mark - (k < mark), None
                if k is None:
                    del self.open[i]
                    continue
                copy = Node(node.tag, node.attrs)
                self.active[k] = self.open[i] = copy
                if last is furthest:
                    mark = k + 1
                copy.put(last)
                last = copy
            last.cut()
            parent, before = self._place(ancestor)
            parent.put(last, before)
            copy = Node(fmt.tag, fmt.attrs)
            for c in list(furthest.children):
                copy.put(c)
            furthest.children = []
            furthest.put(copy)
            self.active.insert(mark, copy)
            self._forget(fmt)
            self.open = [n for n in self.open if n is not fmt]
            self.open.insert(next(i for i, n in enumerate(self.open) if n is furthest) + 1, copy)

    def _scoped(self) -> list[Node]:
        out = []
        for n in reversed(self.open):
            out.append(n)
            if n.tag in SCOPE:
                break
        return out

    # -- tables

    def _context(self) -> str:
        """The part of a table that the next tag is in; body if it is in a cell, a caption or no table."""
        for n in reversed(self.open):
            if n.tag in CELLS | {"caption"}:
                return "cell"
            if n.tag in {"table", "tr", "colgroup"} | BODIES:
                return "body" if n.tag == "html" else n.tag
        return "body"

    def _close_cell(self) -> None:
        inside = next(n.tag for n in reversed(self.open) if n.tag in CELLS | {"caption"})
        self._imply()
        self._pop_to({inside})
        self._clear_marker()

    def _table_start(self, tag: str, attrs) -> bool:
        """Whether a start tag is dealt with by the rules of tables."""
        where = self._context()
        if where == "cell":
            if tag in TABLE_PARTS and self._has(CELLS | {"caption"}, TABLE_SCOPE):
                self._close_cell()
                return self._table_start(tag, attrs)
            return False
        if where == "body":
            return tag in TABLE_PARTS  # parts of tables elsewhere are not there
        if where == "colgroup":
            if tag == "col":
                self._insert(tag, attrs)
                self.open.pop()
                return True
            self._clear_to({"colgroup"})
            self.open.pop()
            return self._table_start(tag, attrs)
        if tag in CELLS:
            if where == "table":
                self._clear_to({"table"})
                self._insert("tbody")
            if where != "tr":
                self._clear_to(BODIES)
                self._insert("tr")
            self._clear_to({"tr"})
            self._insert(tag, attrs)
            self.active.append(None)
        elif tag == "tr":
            if where == "tr":
                self._clear_to({"tr"})
                self.open.pop()
            if where == "table":
                self._clear_to({"table"})
                self._insert("tbody")
            self._clear_to(BODIES)
            self._insert(tag, attrs)
        elif tag in BODIES | {"caption", "col", "colgroup"}:
            self._clear_to({"table"})
            if tag == "col":
                self._insert("colgroup")
            self._insert(tag, attrs)
            if tag == "caption":
                self.active.append(None)
            elif tag == "col":
                self.open.pop()
        elif tag == "table":
            self._clear_to({"table"})
            self.open.pop()
            self.handle_starttag(tag, attrs)
        elif tag in {"script", "style", "template"} or (tag == "input" and (dict(attrs).get("type") or "").lower() == "hidden"):
            self._insert(tag, attrs)
            if tag == "input":
                self.open.pop()
        else:
            if where != self.open[-1].tag:
                return False  # within something that was put before the table
            self.foster = True
            self._start(tag, attrs)
            self.foster = False
        return True

    def _table_end(self, tag: str) -> bool:
        where = self._context()
        if where == "body":
            return tag in TABLE_PARTS | {"table"}
        if where == "cell":
            inside = next(n.tag for n in reversed(self.open) if n.tag in CELLS | {"caption"})
            if tag == inside or (tag in BODIES | {"table", "tr"} and self._has({tag}, TABLE_SCOPE)):
                self._close_cell()
                return tag == inside or self._table_end(tag)
            return tag in TABLE_PARTS | {"table"}
        if tag == "table" or (tag in BODIES | {"tr"} and self._has({tag}, TABLE_SCOPE)):
            self._clear_to({tag})
            self.open.pop()
            return True
        return tag in TABLE_PARTS

    # -- tokens

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing

    def handle_starttag(self, tag, attrs):
        self.fresh = False
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._body(attrs)
            return
        if self.body is None:
            if tag in HEAD:
                node = Node(tag, attrs)
                self.head.put(node)
                if tag not in VOID:
                    self.open.append(node)
                return
            if self.open[-1].tag == "noscript":
                self.open.pop()
            self._body()
        if not self._table_start(tag, attrs):
            self._start(tag, attrs)

    def _start(self, tag, attrs) -> None:
        if tag in BLOCKS or tag in HEADINGS or tag in {"table", "hr"}:
            self._close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
        elif tag in {"li", "dd", "dt"}:
            ends = {"li"} if tag == "li" else {"dd", "dt"}
            for n in reversed(self.open):
                if n.tag in ends:
                    self._imply({n.tag})
                    self._pop_to({n.tag})
                    break
                if n.tag in SPECIAL and n.tag not in {"address", "div", "p"}:
                    break
            self._close_p()
        elif tag == "button" and self._has({"button"}, SCOPE):
            self._imply()
            self._pop_to({"button"})
        elif tag in {"option", "optgroup"} and self.open[-1].tag == "option":
            self.open.pop()
        elif tag in {"a", "nobr"}:
            old = next((n for n in self._after_marker() if n.tag == tag), None)
            if old is not None:
                self._adopt(tag)
                self._forget(old)
                self.open = [n for n in self.open if n is not old]
        if not (tag in BLOCKS or tag in HEADINGS or tag in HEAD or tag in {"table", "hr", "li", "dd", "dt"}):
            self._reconstruct()
        node = self._insert(tag, attrs)
        if tag in VOID:
            self.open.pop()
        elif tag in FORMATTING:
            self._push(node)
        elif tag in MARKING:
            self.active.append(None)
        self.fresh = tag in {"pre", "listing", "textarea"}

    def handle_endtag(self, tag):
        self.fresh = False
        if self.body is None:
            if self.open[-1].tag == tag and tag in HEAD:
                self.open.pop()
            elif tag in {"p", "br"}:
                self._body()
                self.handle_endtag(tag)
            return
        if tag in {"body", "html", "head"} or self._table_end(tag):
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p":
            if not self._has({"p"}, BUTTON_SCOPE):
                self._insert("p")
            self._close_p()
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in HEADINGS:
            if self._has(HEADINGS, SCOPE):
                self._imply()
                self._pop_to(HEADINGS)
        elif tag in BLOCKS or tag in MARKING or tag in {"li", "dd", "dt", "button"}:
            if self._has({tag}, LIST_SCOPE if tag == "li" else SCOPE):
                self._imply({tag} if tag in {"li", "dd", "dt"} else ())
                self._pop_to({tag})
                if tag in MARKING:
                    self._clear_marker()
        else:
            self._other_end(tag)

    def _other_end(self, tag) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SPECIAL:
                return

    def handle_data(self, data):
        if self.fresh:  # a line break right after the tag does not count
            data, self.fresh = data.removeprefix("\r\n") if data.startswith("\r\n") else data.removeprefix("\n"), False
        if self.body is None:
            if self.open[-1] is not self.root:
                self.open[-1].put(data)
                return
            data = data.lstrip()
            if not data:
                return
            self._body()
        if not data:
            return
        if self.open[-1].tag in BODIES | {"table", "tr", "colgroup"}:
            if not data.strip():
                self.open[-1].put(data)
                return
            if self.open[-1].tag == "colgroup":
                self.open.pop()
            self.foster = True
            self._reconstruct()
            parent, before = self._place()
            parent.put(data, before)
            self.foster = False
            return
        if self.open[-1].tag not in {"script", "style"}:
            self._reconstruct()
        self.open[-1].put(data)
