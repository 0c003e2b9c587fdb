from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import pages


def page(i, body, tail=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<header><a href=/>Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><!-- note <p>no</p> -->"
        f"<div class='left sidebar'>Side {i}</div><div id=main>{body}</div><div class=\"comment-list\"><p>Reader {i}</p></div>"
        f"<form><p>Search</p><input></form>{tail}<footer>&copy; 2020 {i}</footer>"
    )


ROWS = [(i, f"https://A.example/{i}", page(i, f"<h1>Title {i}</h1><p>Same  note</p><p>Text\n<b>bold</b> {i}&amp;&#233;<br>more<p>End {i}")) for i in range(8)]


def told(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' as text", "1 as host", "2 as blocks", "3 as reference"
    )
    return pages.main_text(df).collect()


def test_slots_are_content_and_constants_template(spark):
    for r in told(spark, ROWS):
        i = r["page_id"]
        assert r["text"] == f"Title {i}\n\nText bold {i}&é more\n\nEnd {i}"
        assert r["n_chars"] == len(r["text"]) and r["url"] == f"https://A.example/{i}"


def test_few_pages_have_no_template(spark):
    assert "Same note" in told(spark, ROWS[:3])[0]["text"]


def test_article_only(spark):
    html = "<body><p>Teaser</p><article><header><h1>H</h1></header><p>One<ul><li>a<li>b</ul><aside>x</aside><div class=ads>y</div></article><p>After"
    assert told(spark, [(1, None, html)])[0]["text"] == "H\n\nOne\n\na\n\nb"


PROSE = "A long main text. " * 20

NAMED = {
    "<div class='layout has-sidebar'><article><p>Main</article></div>": "Main",
    "<div class='content with_sidebar'><main><p>Main</main><div class=sidebar>no</div></div>": "Main",
    "<article><div class=entry-header><h1>Title</h1></div><p>Text</article>": "Title\n\nText",
    "<article><div class='header'><h1>Title</h1></div><p>Text<div class=share-buttons>no</div><ol class=comments><li>no</ol></article>": "Title\n\nText",
    f"<div class=body><h2>Head</h2><p>{PROSE}</div><article class=teaser><p>Teaser</article>": f"Head\n\n{PROSE.strip()}\n\nTeaser",
    f"<div class=story><p>{PROSE}</div><div class=related><article>x</article><article>y</article></div><article><p>Z{PROSE}</article>": f"Z{PROSE.strip()}",
    f"<div class=menu-page><p>{PROSE}</div><div class=menu>Soup</div>": PROSE.strip(),
    f"<div><p>Short</div><div id=comments><p>{PROSE}</div>": "Short",
    "<div class=post-header><h1>Title</h1></div><p>Text<div class=siteHeader>no</div><div class='page-header'>no</div><div class=ad_box>no</div>": "Title\n\nText",
    "<div class=adrift>yes</div><div class=headline>yes</div><div class=notices-none>yes</div>": "yes\n\nyes\n\nyes",
}


def test_names_are_weak_evidence(spark):
    rows = [(i, f"https://h{i}.example/", f"<body>{html}") for i, html in enumerate(NAMED)]
    found = {r["page_id"]: r["text"] for r in told(spark, rows)}
    assert [found[i] for i in range(len(rows))] == list(NAMED.values())


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    wide = "<body>" + "".join(f"<p>w{i}" for i in range(3000))
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "http://h/x", "plain &lt;text&gt; \n here"),
        (4, "http://h/y", "<p>a <p>b <unknown>c</unknown></p></div></p>"),
        (5, "not a url", "<p"),
        (6, "http://d/", deep),
        (7, "http://w/1", wide),
        (8, "http://w/2", wide + "<ul><li>z"),
        (9, "http://h/z", "<script>never closed <p>x"),
        (3, "http://h/x", "plain &lt;text&gt; \n here"),
        (None, "http://h/q", "<p>no id &nbsp; here"),
        (10, "http://h/c", "<p>before<!-- open <p>x"),
        (11, "http://h/t", "<table><tr><td>1<td>2<tr><td>3</table>"),
        (12, "http://h/hidden", "<p style='display: none'>x</p><p hidden>y</p><p>z"),
    ]
    found = told(spark, rows)
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[1] == texts[2] == "" and texts[3] == "plain <text> here"
    assert texts[4] == "a\n\nb\n\nc" and texts[6] == "deep" and texts[9] == ""
    assert texts[7].count("\n\n") == 2999 and texts[8].endswith("w2999\n\nz")
    assert texts[None] == "no id here" and texts[10] == "before" and texts[11] == "1\n\n2\n\n3" and texts[12] == "z"
    assert told(spark, [])  == []


TREES = st.recursive(st.sampled_from("abc"), lambda t: st.tuples(st.sampled_from("abc"), st.lists(t, max_size=4)), max_leaves=9)


def markup(tree):
    if isinstance(tree, str):
        return f"<x{tree}></x{tree}>"
    return f"<x{tree[0]}>{''.join(map(markup, tree[1]))}</x{tree[0]}>"


def most(a, b):
    """Largest number of matched nodes, by trying all ways."""
    if a.tag != b.tag:
        return 0

    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        gain = most(a.children[i], b.children[j])
        return max(best(i + 1, j), best(i, j + 1), gain + best(i + 1, j + 1) if gain else 0)

    return 1 + best(0, 0)


@settings(max_examples=80, deadline=None)
@given(TREES, TREES)
def test_tree_matching_is_best(left, right):
    a, b = pages.parse(markup(left))[0], pages.parse(markup(right))[0]
    found = pages.align(a, b)
    assert len(found) == most(a, b)
    assert len(set(found.values())) == len(found)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/!-pdivab =\"'&;#1 \n", max_size=60))
def test_any_text_parses(source):
    tree, blocks = pages.parse(source)
    pages.align(tree, tree)
    assert all(b.text == " ".join(b.text.split()) != "" for b in blocks)


def test_wide_lists_align_in_order(monkeypatch):
    monkeypatch.setattr(pages, "TABLE_CELLS", 4)
    a = pages.parse("<ul><li>1<li>2<li>3</ul><p>x")[0]
    b = pages.parse("<ul><li>1<li>2</ul><p>y")[0]
    found = pages.align(a, b)
    assert len(found) == 5


def test_copies_give_no_evidence(spark):
    def article(i, n):
        return "<body><section>Notice</section><div>" + "".join(f"<p>Part {k} of {i}</p>" for k in range(n)) + "</div>"

    rows = [(i, "http://copies/a", article(0, 6)) for i in range(60)]
    rows += [(100 + i, "http://copies/b", article(i, 2)) for i in range(1, 6)]
    found = {r["page_id"]: r["text"] for r in told(spark, rows)}
    assert found[0] == found[59] == "\n\n".join(f"Part {k} of 0" for k in range(6))
    assert found[103] == "Part 0 of 3\n\nPart 1 of 3"


def test_text_after_a_deep_nest_stays_in_its_article():
    def texts(n):
        source = "<body><div><article><p>One</p>" + "<div>" * n + "deep" + "</div>" * n + "<p>Two</p></article></div><p>Out"
        return [(b.text, b.node.article) for b in pages.parse(source)[1]]

    assert texts(400) == texts(1) == [("One", True), ("deep", True), ("Two", True), ("Out", False)]
    tree = pages.parse("<div>" * 400)[0]
    pages.align(tree, tree)


def test_wide_lists_match_as_many_nodes(monkeypatch):
    wide = "<p>x</p>" * 150
    a, b = pages.parse(f"<div>1</div>{wide}")[0], pages.parse(f"{wide}<div>1</div>")[0]
    assert len(pages.align(a, b)) == 151
    monkeypatch.setattr(pages, "TABLE_CELLS", 2)
    rng = random.Random(4)
    for _ in range(60):
        x, y = ("".join(rng.choice(("<ul><li>a</ul>", "<ul></ul>", "<p>b</p>", "<h1>c</h1>")) for _ in range(7)) for _ in "xy")
        a, b = pages.parse(x)[0], pages.parse(y)[0]
        found = pages.align(a, b)
        assert len(found) == len(set(found.values())) == most(a, b)


def test_every_layout_has_its_template(spark):
    def article(i):
        return f"<body><div><section>Written by us</section><h1>T{i}</h1><p>Text {i}</p></div><p>All rights"

    def listing(i):
        return f"<body><table><tr><td>Our list</td><td>Row {i}</td></tr></table><ul><li>Entry {i}</ul><p>All rights"

    rows = [(0, "http://m/error", "<body><pre>Broken")]
    rows += [(i, "http://m/x", article(i) if i % 2 else listing(i)) for i in range(1, 41)]
    found = {r["page_id"]: r["text"] for r in told(spark, rows)}
    assert found[0] == "Broken" and found[7] == "T7\n\nText 7" and found[8] == "Row 8\n\nEntry 8"
