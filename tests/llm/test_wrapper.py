"""Main text of pages: planted templates, alignment against all matchings, odd pages."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from turnwise.llm import wrapper
from turnwise.llm.wrapper import Page, Tree, matched

SCHEMA = "page_id long, url string, html string"
WORDS = "river stone walks under bright old tower singing quiet market seven lanterns".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def soup(rng, i, site):
    """A page without an article element or telling names; the template's text is the same on all pages."""
    title, first, second = f"Title {i} {prose(rng, 3)}", prose(rng, 40), prose(rng, 30)
    cards = "".join(f'<div><a href="/{k}">{prose(rng, 3)}</a></div>' for k in range(rng.randint(2, 5)))
    extra = f"<ul><li>{prose(rng, 4)}</li><li>point {i}</li></ul>" if i % 3 == 0 else ""
    points = extra and [x for x in extra.replace("<ul>", "").replace("</ul>", "").replace("<li>", "").split("</li>") if x]
    html = (
        f"<html><body><div><a href='/'>Home</a> <span>{site}</span></div><div>{cards}</div>"
        f"<div><div><h1>{title}</h1><p>{first}<p>{second}</p>{extra}<div>Written for {site}. All rights kept by us.</div></div></div>"
        f"<div>Imprint of {site}</div></body></html>"
    )
    return html, "\n\n".join([title, first, second, *(points or [])])


def named(rng, i):
    """A page with everything that is to go, by element, role, name or class."""
    a, b, c = prose(rng, 12), prose(rng, 20), prose(rng, 5)
    html = (
        f"<!DOCTYPE html><html><head><title>t {i}</title><style>p{{}}</style><script>var x='<p>no</p>'; if (a<b) {{}}</script></head><body class='has-sidebar'>"
        f"<header><h1>Site</h1><p>{prose(rng, 6)}</p></header><nav><ul><li><a href='/'>{prose(rng, 2)}</a></li></ul></nav>"
        f"<div class='cookie-notice'>{prose(rng, 30)}</div><!-- <p>gone</p> --><div id='leftSidebar'><p>{prose(rng, 60)}</p></div>"
        f"<main><article><header><h1>Head {i} &amp; more</h1></header><p>{a}</p><div class='ad'>{prose(rng, 9)}</div>"
        f"<p>{b[:20]}<b>{b[20:]}</b>&nbsp;<br> tail&eacute;</p><form action='/x'><p>{prose(rng, 5)}</p><input></form><aside>{prose(rng, 40)}</aside><p>{c}</p>"
        f"<footer>{prose(rng, 5)}</footer></article><section id='comments'><article><p>{prose(rng, 90)}</p></article></section></main>"
        f"<div role='complementary'>{prose(rng, 9)}</div><footer>&copy; {prose(rng, 3)}</footer></body></html>"
    )
    return html, f"Head {i} & more\n\n{a}\n\n{b} tailé\n\n{c}"


def texts(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("host", "kind", "blocks", "salt", "text", "kept", "node"):
        df = df.withColumn(name, F.lit("x"))
    out = wrapper.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.url, r.text) for r in got), key=str)


def test_template_of_a_host_goes_and_its_articles_stay(spark):
    rng = random.Random(4)
    rows, want = [], []
    for site in ("one.example", "two.example"):
        for i in range(12):
            html, text = soup(rng, i, site)
            rows.append((len(rows), f"http://{site}/{i}", html))
            want.append((len(want), f"http://{site}/{i}", text))
    assert texts(spark, rows) == sorted(want, key=str)


def test_names_roles_and_elements(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(8):
        html, text = named(rng, i)
        rows.append((i, f"https://host{i % 4}.example/{i}?q=1", html))  # two pages a host: nothing is template yet
        want.append((i, rows[-1][1], text))
    assert texts(spark, rows) == sorted(want, key=str)


def test_copies_of_an_article_are_no_template(spark):
    html = "<body><nav>menu {0}</nav><article><h1>Same</h1><p>The same words on all pages of this host.</p></article></body>"
    rows = [(i, f"http://h.example/{i}", html.format(i % 3)) for i in range(9)]
    assert {t for _, _, t in texts(spark, rows)} == {"Same\n\nThe same words on all pages of this host."}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>far down</p>" + "</div>" * 3000
    rows = [
        (0, "http://h/0", None), (1, "http://h/1", ""), (2, None, "<p>no url"), (None, "http://h/2", "just text &lt;3"), (4, "nonsense", "<article></article>"),
        (5, "http://d/1", deep), (6, "http://t/1", "<p>cut off <a href='x"), (7, "http://t/2", "<article><p>a<p>b<li>c</article><div>x</div>"),
        (8, "http://s/1", "<article>a<script>never ended <p>b</p>"), (9, "http://s/2", "<article><p>1 < 2 &amp;&amp; 3 > 2</p></article>"),
        (9, "http://s/2", "<article><p>1 < 2 &amp;&amp; 3 > 2</p></article>"), (10, "http://q/1", "<article><p title='a>b' data-x=\"</p>\">quoted</p></article>"),
        (11, "http://f/1", "<form><h1>T</h1><div><p>a page that is all one form, as some old ones are</p></div></form>"),
        (12, "http://tb/1", "<main><table><tr><td>a<td>b<tr><td>c</table></main>"), (13, "http://z/1", "<article>" + "<p>word</p>" * 20_000 + "</article>"),
    ]
    got = {(i, u): t for i, u, t in texts(spark, rows)}
    assert len(texts(spark, rows)) == len(rows)
    assert got[0, "http://h/0"] == got[1, "http://h/1"] == got[4, "nonsense"] == ""
    assert got[2, None] == "no url"
    assert got[None, "http://h/2"] == "just text <3"
    assert got[5, "http://d/1"] == "far down"
    assert got[6, "http://t/1"] == "cut off"
    assert got[7, "http://t/2"] == "a\n\nb\n\nc"
    assert got[8, "http://s/1"] == "a"
    assert got[9, "http://s/2"] == "1 < 2 && 3 > 2"
    assert got[10, "http://q/1"] == "quoted"
    assert got[11, "http://f/1"] == "T\n\na page that is all one form, as some old ones are"
    assert got[12, "http://tb/1"] == "a\n\nb\n\nc"
    assert got[13, "http://z/1"] == "\n\n".join(["word"] * 20_000)


def test_empty_table(spark):
    assert wrapper.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_host_is_dealt_out(spark):
    """Most pages are of one kind: they are joined with their rule by several keys."""
    rows = [(i, f"http://hot.example/{i}", f"<body><div>fixed</div><article><p>page {i}</p></article></body>") for i in range(300)]
    assert [t for _, _, t in sorted(texts(spark, rows))] == [f"page {i}" for i in range(300)]


def random_skeleton(rng, n):
    lines, depth = ["0 root"], 0
    for _ in range(n):
        depth = rng.randint(1, depth + 1)
        lines.append(f"{depth} {rng.choice(['div', 'p', 'ul'])}")
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_the_largest(seed):
    """Against a plain recursion over all ordered matchings, and valid: labels, parents and order."""
    rng = random.Random(seed)
    a, b = Tree(random_skeleton(rng, rng.randint(0, 9))), Tree(random_skeleton(rng, rng.randint(0, 9)))

    @lru_cache(None)
    def best(u, v):
        return 1 + forest(tuple(a.kids[u]), tuple(b.kids[v])) if a.labels[u] == b.labels[v] else 0

    @lru_cache(None)
    def forest(x, y):
        if not x or not y:
            return 0
        return max(forest(x[1:], y), forest(x, y[1:]), best(x[0], y[0]) + forest(x[1:], y[1:]))

    got = matched(a, b)
    assert len(got) == best(0, 0)
    assert len(set(got.values())) == len(got)
    for u, v in got.items():
        assert a.labels[u] == b.labels[v]
        assert u == 0 or got[a.parent[u]] == b.parent[v]
    for v in range(len(a.labels)):
        order = [got[k] for k in a.kids[v] if k in got]
        assert order == sorted(order)


def test_pages_of_other_lengths_have_one_tree():
    short = Page("<body><div class=x><p>a</p></div><ul><li>1</ul>")
    long = Page("<body><div class=x><p>a</p><p>b</p></div><div class=x><p>c</p></div><ul><li>1<li>2<li>3</ul>")
    assert short.skeleton() == long.skeleton()
    assert [t for _, t, _ in long.blocks] == ["a", "b", "c", "1", "2", "3"]
