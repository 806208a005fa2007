import os
import random
import re
import subprocess
import sys
import time

import pytest

from lumenfold.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><a href="/">Site</a></header><nav><ul><li>Menu</li></ul></nav><div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article class="post"><header><h1>The  title &amp; more</h1></header><p><b>First<br><p>Second&nbsp;part <i>in</i>line<span class="ad"> buy now</span>.</p><ul><li>one<li>two</ul>
<form>Search <input></form><div class="share">Share</div><table><tr><td>c1<td>c2</table></article>
<section id="comments"><article class="comment"><p>Reader says</p></article></section><aside>Related</aside><footer>&copy; 2020</footer></body></html>"""


def test_article_of_a_lone_page():
    # Names inside the article don't count where there is no other page to compare with, tags do.
    assert H.alone(PAGE).split("\n") == ["The title & more", "First", "Second part inline buy now.", "one", "two", "Share", "c1", "c2"]
    assert "Menu" in H.extract(PAGE, None) and "Reader says" in H.extract(PAGE, None)


def test_article_without_furniture(spark):
    df = spark.createDataFrame([(i, "http://h/", PAGE.replace("First", f"First {i}").replace("two", f"two {i}").replace("Buy", f"Buy {i}")) for i in range(9)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract_pages(df).collect()}
    # What is the same on all pages is the template's, wherever it stands.
    assert got == {i: [f"First {i}", f"two {i}"] for i in range(9)}


def test_names_do_not_drop_text_of_the_article():
    page = "<body><article><p>Text <span class='notice'>inline words</span> more <a class='related'>link</a>.</p><p class='login-help'>Help</p><div class='search'>Found</div></article><div class=ad>Ad</div></body>"
    assert H.alone(page).split("\n") == ["Text inline words more link.", "Help", "Found"]
    others = [f"<body><article><p>Text {i}</p><p>more of {i}</p></article><div class=ad>Ad {i}</div></body>" for i in range(9)]
    template = H.induce([H.slots(H.parse(p)) for p in [page, *others]])
    assert H.extract(page, template).split("\n") == ["Text inline words more link.", "Help", "Found"]
    assert H.extract(others[3], template).split("\n") == ["Text 3", "more of 3"]


@pytest.mark.parametrize("page, text", [("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>x<!-- y --> z</div>", "x z"), ("<p>1 < 2 &lt; 3 &am</p>", "1 < 2 < 3 &am"), ("<p>cut <b", "cut"), ("<script>a", ""), ("<nav>only</nav>", ""), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<div class=ad>" * 5000 + "<h1>deep</h1>", "deep"), ("<nav>" * 5000 + "</x>" * 5000 + "menu", ""), ("<div><section>" * 5000 + "deep<nav>menu</nav><div class=sidebar>side</div>", "deep"), ("<i><div>" * 210 + "<div class='sidebar'>side</div><p>text", "text"), ("<p>a <svg><text>x</text></svg> b <button>c</button> d", "a b d")])
def test_broken_and_deep_markup(page, text):
    assert H.alone(page) == text
    H.induce([H.unpacked(H.packed(H.slots(H.parse(page)))) for _ in range(3)])


def test_deeper_than_any_template():
    page = "<div><section>" * (H.LEVELS // 2 + 5) + "deep<nav>menu</nav>"
    assert H.extract(page, {"slots": [[0, "#page", H.IN, False]]}) == "deep"


def brute_match(a, b):
    """Simple tree matching by trying all ways to pair children in order."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), (brute_match(x[0], y[0]) + best(x[1:], y[1:])) if x[0].label == y[0].label else 0)

    return 1 + best(a.children, b.children)


def test_simple_tree_matching_against_brute_force():
    r = random.Random(3)

    def tree(level):
        s = H.Slot(r.choice("abc"), frozenset(), 0)
        s.children = [tree(level + 1) for _ in range(r.randint(0, 4 - level))]
        return s

    seen = 0
    for _ in range(200):
        a, b = tree(0), tree(0)
        b.label = a.label
        w = H.matched(a, b, {})
        assert w == brute_match(a, b)
        pairs = H.aligned(a.children, b.children, {})
        assert [p for p, _ in pairs if p] == a.children and [q for _, q in pairs if q] == b.children
        if [p.label for p in a.children] != [q.label for q in b.children]:
            assert 1 + sum(H.matched(p, q, {}) for p, q in pairs if p and q) == w
            seen += w > 2
    assert seen > 20


def test_long_unlike_lists_are_aligned_quickly():
    pages = ["<body>" + "".join(f"<div class=c{chr(97 + (i * k) % 23)}><h2>t</h2><{'p' if i % k else 'table'}>text {i}</div><div>{'<section>' * (i % 7)}x" + "</section>" * (i % 7) + "</div>" for i in range(1500)) + "</body>" for k in (1, 2, 3)]
    made = [H.slots(H.parse(p)) for p in pages]
    began = time.perf_counter()
    template = H.induce(made)
    assert time.perf_counter() - began < 1
    assert len(H.extract(pages[0], template)) > 5000


def unnamed(i, menu=True):
    """A page without a telling tag or name; every part varies from page to page."""
    r = random.Random(i)
    word = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    body = [f"Title {i} {word(3)}", *[f"{word(40)}" for _ in range(r.randint(2, 6))], f"item {word(4)}"]
    html = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:-1]) + f"<ul><li>{body[-1]}</ul>"
    nav = "<div><ul>" + "".join(f"<li><a href=/{j}>{word(1)}</a>" for j in range(r.randint(2, 5))) + "</ul></div>" if menu else ""
    return f"<html><body>{nav}<div>{word(6)}</div><div>{html}</div><div>&copy; site {word(5)}</div></body></html>", body


def test_unnamed_furniture_goes_by_the_template_alone(spark):
    made = [unnamed(i, menu=i % 4 > 0) for i in range(40)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id int, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract_pages(df, names=False).collect()}
    assert got == {i: b for i, (_, b) in enumerate(made)}
    assert all(H.extract(p, None).split("\n") != b for p, b in made)


def test_the_template_decides_on_the_given_pages(spark):
    """With tags and names ignored, every page gives the text of its article element; without a template none does."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = {r["page_id"]: r["text"] for r in H.extract_pages(pages, names=False).collect()}
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(source) == 2500
    for i, text in rows.items():
        own = source[i]
        article = own[own.index("<article>") : own.index("</article>")]
        assert text == H.extract(article, None) and text != H.extract(own, None)


def pages(n, body="<p>text number {i} of its own</p>"):
    return [f"<body><div class=top>Same top</div><div class=main><p>Read all about it</p>{body.format(i=i)}</div><div class=low>Same low</div></body>" for i in range(n)]


def test_constant_nodes_are_template_and_varying_slots_content(spark):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages(20))], "page_id int, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    assert got == {i: f"text number {i} of its own" for i in range(20)}


def test_copies_do_not_become_template(spark):
    df = spark.createDataFrame([(i, "http://h.example/", pages(1)[0]) for i in range(30)], "page_id int, url string, html string")
    assert {r["text"] for r in H.extract_pages(df).collect()} == {"Same top\nRead all about it\ntext number 0 of its own\nSame low"}


def test_odd_rows_and_both_ways_of_joining_templates(spark):
    rows = [(1, None, None, "x"), (2, "http://h/a", "", "x"), (3, "no url", "<p>a</p>", "x"), (4, "HTTP://H/b", "<article>b</article>", "x"), (4, "HTTP://H/b", "<article>b</article>", "x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    a = sorted((r["page_id"], r["text"]) for r in H.extract_pages(df).collect())
    assert a == [(1, ""), (2, ""), (3, "a"), (4, "b"), (4, "b")]
    assert a == sorted((r["page_id"], r["text"]) for r in H.extract_pages(df, broadcast_chars=0).collect())
    assert H.extract_pages(df.where("false")).count() == 0


def test_hosts_without_article_keep_titles_lists_and_tables(spark):
    body = "<h1>Title {i}</h1><p>" + "some long text of page {i} " * 20 + "</p><p>more of {i}</p><ul><li>item {i}</ul><table><tr><td>cell {i}</table>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", f"<body>{body.format(i=i)}</body>") for i in range(20)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract_pages(df).collect()}
    assert got == {i: [f"Title {i}", " ".join(["some long text of page", str(i)] * 20), f"more of {i}", f"item {i}", f"cell {i}"] for i in range(20)}


def test_constants_are_counted_over_all_pages_of_a_layout(spark):
    def layout(name, i):
        return f"<body><div class={name}><div class=top>Top of {name}</div><h1>Title {i}</h1><p>Text {i} is long enough</p></div></body>"

    kinds = ["a"] * 180 + ["b"] * 110 + ["c"] * 10
    rows = [(i, "http://hot/", layout(k, i)) for i, k in enumerate(kinds)] + [(1000 + i, "http://small/", layout("d", i)) for i in range(3)] + [(2000, "http://one/", layout("e", 0))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    want = {i: f"Title {i % 1000}\nText {i % 1000} is long enough" for i, *_ in rows}
    assert got == want | {2000: "Top of e\nTitle 0\nText 0 is long enough"}


@pytest.mark.parametrize("kind", ["social-story", "comment-piece", "notice-board-article", "newsletter-body"])
@pytest.mark.parametrize("n", [1, 2, 12])
def test_names_never_take_the_running_text(spark, kind, n):
    r = random.Random(n)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(3, 8)))
    stories = [" ".join(word() for _ in range(100)) for _ in range(n)]
    rows = [(i, f"http://{kind}.example/{i}", f'<body><div class="top">Site name</div><div class="{kind}"><p>{t}</p><div class="share">Share this</div></div><div class="end">All rights</div></body>') for i, t in enumerate(stories)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(stories[g["page_id"]] in g["text"] for g in got)
    assert n < 2 or not any("Share this" in g["text"] for g in got)


def test_comments_that_outweigh_the_article_go(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(3, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, f"http://a.example/{i}", f'<body><div class="story"><p>{text(60)}</p></div><div class="comments"><p>{text(140)}</p></div></body>') for i in range(12)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    source = {i: re.findall(r"<p>(.*?)</p>", h) for i, _, h in rows}
    assert all(g["text"] == source[g["page_id"]][0] for g in got)


def texts_of(page):
    return [t for _, _, t, _ in H.blocks(H.parse(page))]


def test_quotes_open_only_after_an_equals_sign():
    assert texts_of("<p title=it's>Hello don't stop</p><p>two</p>") == ["Hello don't stop", "two"]
    assert texts_of("<p title='a>b'>x</p><p title=\"<b>\">y</p><p a=b=\"c>z</p>") == ["x", "y", "z"]
    assert texts_of("<p don't>x</p> it's <p>y</p>") == ["x", "it's", "y"]
    assert texts_of("a < b <p>c <3 d</p>") == ["a < b", "c <3 d"]
    assert texts_of("<p title='never closed>one</p><p>two</p>")[-1] == "two"


@pytest.mark.parametrize("part", ["<a href='", '<a href="', "<a ", "<!", "<!--", "<a b='<c d=\"", "</a x=", "<p>", "<a href='>", "<a b=\"'>x"])
def test_hostile_markup_takes_linear_time(part):
    began = time.time()
    H.parse(part * (400_000 // len(part)))
    assert time.time() - began < 4


def test_functions_run_without_the_package(tmp_path):
    """What travels to executors brings its code along: a bare interpreter elsewhere reads a page with it."""
    from pyspark import cloudpickle

    whole = lambda page: [t for _, _, t, _ in H.blocks(H.parse(page))]
    (tmp_path / "f").write_bytes(cloudpickle.dumps((H.parse, H.blocks, H.induce, H.template_of, H.extract)))
    code = "import pickle, sys; sys.path = [p for p in sys.path if 'repo' not in p]; parse, blocks, *_ = pickle.load(open('f', 'rb')); print([b[2] for b in blocks(parse('<p class=a>x</p>'))])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert done.stdout.strip() == "['x']", done.stderr
    assert whole("<p>x</p>") == ["x"]


@pytest.mark.parametrize("parts", [1, 7, 10_000])
def test_a_template_goes_once_before_each_part_of_its_host(spark, monkeypatch, parts):
    monkeypatch.setattr(H, "PARTS", parts)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 12}'}.example/{i}", p, {"k": "v"}) for i, p in enumerate(pages(120))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, extra map<string,string>").repartition(3)
    held = H.extract_pages(df, broadcast_chars=0)
    assert held.columns == ["page_id", "url", "html", "extra", "text"]
    a = {r["page_id"]: (r["text"], r["extra"]["k"]) for r in held.collect()}
    assert a == {i: (f"text number {i} of its own", "v") for i in range(120)}
    keyed = df.withColumn("h", H.host_of(H.F.col("url")))
    both = H.beside_templates(keyed, H.templates(df), "h", "t").withColumn("at", H.F.spark_partition_id())
    heads = both.where("t is not null").groupBy("h").agg(H.F.count("*").alias("n")).collect()
    assert both.where("t is null").count() == 120 and {r["h"]: r["n"] for r in heads}["hot.example"] == min(-(-80 * parts // 120), 10_000)


def test_every_page_of_a_host_shapes_its_template(spark):
    """The pages of smallest signature all lack a second container of running text, which most others have: it is content."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(3, 8)))
    short, full = [], []
    while len(short) < 70 or len(full) < 130:
        a, b = (" ".join(word() for _ in range(40)) for _ in range(2))
        for more, held, most in ((False, short, 70), (True, full, 130)):
            body = f"<body><div class=top>Top {word()}</div><div class=left><p>{a}</p></div>" + (f"<div class=right><p>{b}</p></div>" if more else "") + f"<div class=low>Low {word()}</div></body>"
            if (H.signature(H.blocks(H.parse(body))) > 0) == more and len(held) < most:
                held.append((body, [a, b] if more else [a]))
                break
    made = short + full
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, (p, _) in enumerate(made)], "page_id int, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract_pages(df).collect()}
    assert all(set(b) <= set(got[i]) for i, (_, b) in enumerate(made))


@pytest.mark.parametrize("fold, cells", [(512, 10_000), (2, 10_000), (3, 1)])
def test_slots_are_counted_over_all_distinct_pages(spark, monkeypatch, fold, cells):
    """However shapes are dealt, and also where long lists leave slots without a partner, nothing is lost."""
    monkeypatch.setattr(H, "FOLD", fold)
    monkeypatch.setattr(H, "CELLS", cells)
    r = random.Random(11)
    part = lambda i: r.choice([f"<p>text {i} {r.random()}</p>", "<div class=k>same<b>x</b></div>", f"<div><ul><li>item {i}</ul></div>", f"<div><p>in {i}</p><a href=/>link {i}</a></div>", f"<section><h2>{i}</h2></section>"])
    made = [(f"http://h{i % 2}/", "<body>" + "".join(part(i) for _ in range(r.randint(1, 7))) + "</body>") for i in range(120)]
    df = spark.createDataFrame(made + made[:30], "url string, html string").repartition(3)
    seen = H.scanned(df)
    fixed, shapes = H.constants(seen), H.shapes_of(seen)
    assert shapes.count() > 60 and shapes.agg(H.F.sum("n")).first()[0] == seen.where("paged").count() <= 120
    template = H.aligned_shapes(shapes)
    rows = {x["h"]: x["slots"] for x in H.counted(seen, shapes, template, fixed).collect()}
    assert template.count() == len(rows) == 2
    want = {h: [0, 0, 0] for h in rows}
    known = {h: {x["text"] for x in fixed.where(f"h = {h}").collect()} for h in rows}
    for x in seen.where("paged").collect():
        varying = sum(n for t, n in zip(x["own"], x["sizes"], strict=True) if t not in known[x["h"]])
        want[x["h"]] = [a + b for a, b in zip(want[x["h"]], (sum(x["lengths"]), sum(x["links"]), varying), strict=True)]
    assert {h: [sum(s[k] for s in own) for k in ("length", "link", "varying")] for h, own in rows.items()} == want
    assert all(s["pages"] <= 60 for own in rows.values() for s in own)
    assert {h: next(s["pages"] for s in own if s["slot"] == 0) for h, own in rows.items()} == {x["h"]: x["n"] for x in seen.where("paged").groupBy("h").agg(H.F.count("*").alias("n")).collect()}


def test_names_of_one_page_alone_do_not_split_a_template(spark, monkeypatch):
    """Classes that only one page has: with as many kinds of container as pages there is one slot for them, and one for those named as furniture."""
    monkeypatch.setattr(H, "RARE", 20)
    r = random.Random(13)
    word = lambda n: " ".join("".join(r.choice("aeinrstlo") for _ in range(7)) for _ in range(n))
    stories = [word(40) for _ in range(60)]
    made = [f'<body><div class="top">{word(3)}</div><div class="post {word(1)}q"><p>{t}</p></div><div class="ad {word(1)}q"><p>{word(9)}</p></div><div>{word(4)}</div></body>' for t in stories]
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(made)], "page_id int, url string, html string").repartition(3)
    found = H.templates(df).first()["template"]
    assert len(H.json.loads(found)["slots"]) < 12
    assert {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()} == dict(enumerate(stories))
    assert {r["page_id"]: r["text"] for r in H.extract_pages(df, broadcast_chars=0).collect()} == dict(enumerate(stories))
