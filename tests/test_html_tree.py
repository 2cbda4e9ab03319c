"""Tree construction on broken HTML: what the public standard says comes out."""

import pytest

from docquarry.sources.html_tree import Node, Tree
from docquarry.sources.parsers import parse_html


def shown(node):
    inner = "".join(c if isinstance(c, str) else shown(c) for c in node.children)
    return f"<{node.tag}>{inner}</{node.tag}>"


def body(html):
    return "".join(c if isinstance(c, str) else shown(c) for c in Tree(html).body.children)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p><b>one<p>two", "<p><b>one</b></p><p><b>two</b></p>"),
        ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
        ("<a href=x>1<a href=y>2", "<a>1</a><a>2</a>"),
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
        ("<table>x<tr><td>1<td>2<tr><th>3</table>", "x<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody></table>"),
        ("<table><td>1<table><td>2</table>3</table>4", "<table><tbody><tr><td>1<table><tbody><tr><td>2</td></tr></tbody></table>3</td></tr></tbody></table>4"),
        ("<table><tr><p>out<td><p>in</table>", "<p>out</p><table><tbody><tr><td><p>in</p></td></tr></tbody></table>"),
        ("<table><caption>c<tr><td>1</table>", "<table><caption>c</caption><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<table><col><td>1<tbody><tr><td>2</table>", "<table><colgroup><col></col></colgroup><tbody><tr><td>1</td></tr></tbody><tbody><tr><td>2</td></tr></tbody></table>"),
        ("<table><td>1</table></td></tr>x", "<table><tbody><tr><td>1</td></tr></tbody></table>x"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("<p>a<div>b</div>c</p>d", "<p>a</p><div>b</div>c<p></p>d"),
        ("<button>a<p>b<button>c", "<button>a<p>b</p></button><button>c</button>"),
        ("a</p>b<br/>c</br>d", "a<p></p>b<br></br>c<br></br>d"),
        ("<td>1</td><tr>2<caption>3", "123"),
        ("<p>a</body>b</html><p>c", "<p>ab</p><p>c</p>"),
        ("<title>t</title>  <meta><p>x", "<p>x</p>"),
        ("<html><head><style>p{}</style></head><body class=k>y</body>", "y"),
        ("<pre>\n\na</pre>", "<pre>\na</pre>"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
        ("<div><span>a</div>b", "<div><span>a</span></div>b"),
        ("<i><i><i><i>a<p>b", "<i><i><i><i>a<p>b</p></i></i></i></i>"),
        ("", ""),
        ("just text", "just text"),
        ("<div/>x", "<div>x</div>"),
    ],
)
def test_tree(html, want):
    assert body(html) == want


def test_blocks_of_broken_pages():
    got = [(b["type"], b["text"]) for b in parse_html("<title>t</title><h1>A</h1><p>one <b>two<p>three</b> four<table><tr><td>1<td>2<p>note<tr><td>3</table><ul><li>x<li>y")]
    assert got[0][0] == "heading" and ("list", "- x\n- y") in got and ("table", "1 | 2 note\n3") in got
    got = [(b["type"], b["text"]) for b in parse_html("<table><p>before<tr><td>cell</table>")]
    assert got == [("paragraph", "before"), ("table", "cell")]


def test_random_tags_never_fail():
    import random

    tags = "p b i a div table tr td tbody caption col ul li h1 h2 span button object pre select option body html head script br hr dl dt dd nobr form input".split()
    for seed in range(1500):
        rng = random.Random(seed)
        html = "".join(rng.choice(["<%s>", "<%s>", "</%s>", "<%s>x", "text%.0s", " %.0s", "\n%.0s"]) % rng.choice(tags) for _ in range(rng.randint(1, 40)))
        tree = Tree(html)
        seen: set = set()
        stack = [tree.root]
        while stack:  # every node stands in one place, and knows where
            node = stack.pop()
            assert id(node) not in seen
            seen.add(id(node))
            for c in node.children:
                if isinstance(c, Node):
                    assert c.parent is node
                    stack.append(c)
        assert tree.body is not None


def test_deep_nesting():
    assert len(list(Tree("<div>" * 5000 + "x").body.walk())) == 5000
    assert parse_html("<b><p>" * 300) == []
