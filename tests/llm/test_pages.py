import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from backhaul.llm import site_tree
from backhaul.llm.site_tree import extract, main_text, parse, parsed, site_trees, site_values
from backhaul.llm.url_filter import RULES, judge_urls

# --- urls ------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://a.org/x", "HTTP://A.B.Org/es/",
    "https://example.org/es/7", "https://example.org/es", "https://m.EXAMPLE.org/en/1", "https://example.org/en/2?x=1",
    "https://badexample.org/es/1", "https://example.org?es/", "x://y.com/fr/#a", "x://y.com/fr#/", "x://com/de/?q",
    "x://y.com/DE/1", "http://user:p@example.org:80/es/", "http://org./x", "http://.org/x", "http://a..org/x",
    "http://example.org/es/\n2", "http://éxample.org/é", "http://a.com/de/http://b.org/", "http://net/",
    "http://example.org/en/1\U0010ffff", "http://example.org/en/1é", "a://b://c.org/", "http://exa\nmple.org/x",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judged(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fits:
        return host, path, None, "allow" if host else "block"
    best = max(fits, key=lambda r: (len(r[1] + r[2]), r[1].count("."), r[0]))
    return host, path, best[1] + best[2], best[0]


def test_judge_urls(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://a.org/", "clash"), (1, URLS[1], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, stack string")
    found = [tuple(r) for r in judge_urls(pages).collect()]
    assert sorted(found, key=str) == sorted([(i, *judged(u, RULES)) for i, u, _ in rows], key=str)
    assert judge_urls(pages.limit(0)).count() == 0


def test_nested_rules(spark):
    pick = random.Random(11)
    hosts = ["a", "b.a", "c.b.a", "b", "d.c.b.a"]
    paths = ["/", "/x", "/x/", "/x/y", "/xy", "/x/y/z", "/é"]
    rules = [(pick.choice(["allow", "block"]), h, p) for h in hosts for p in paths if pick.random() < 0.7]
    rules += [("block", *r[1:]) for r in rules[:3]]
    urls = [f"s://{pick.choice(['', 'w.', 'v.w.'])}{pick.choice(hosts + ['e'])}{pick.choice(paths)}{pick.choice(['', 'y', '/y', '#'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules).collect()}
    assert found == {i: judged(u, rules) for i, u in enumerate(urls)}


# --- page text ------------------------------------------------------------------------


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="header page">
      <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use</div>
      <article><header><h1>Head&amp;line</h1><span>by me</span></header><p>A <b>bold</b>
       word&nbsp;here<br>next <!-- no --> line<p>open<i>ended<script>var t = "</p>";</script><div class="ad">buy</div>
      <table><tr><td>1<td>2</table><form>Name <input name=x></form><ul><li>a<li>b</ul><aside>side</aside>
      <div id="comments"><article class="comment"><p>first!</p></article></div><p hidden>gone</p>
      <p>1 < 2 &lt;p&gt; &#233;&eacute; <a title="a > b">link</a></p></article><footer>&copy; us</footer>"""
    expected = ["Head&line", "A bold word here", "next line", "openended", "1", "2", "a", "b", "1 < 2 <p> éé link"]
    assert main_text(page, []).split("\n") == expected


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a</p><div class='sidebar'>b</div>c", "a\nc"),
        ("<main><p>x</p></main><p>y</p>", "x"),
        ("<div class='has-sidebar'><p>x</p><div id=siteFooter>y</div><div class='adBanner'>z</div></div>", "x"),
        ("<main class='with-header header'><p class=gradient>x</p><p class=commentsList>y</p></main>", "x"),
        ("<p>cut <b", "cut <b"),
        ("</p></div><p>a</p></p>b", "a\nb"),
        ("<script>never closed <p>a</p>", ""),
        ("<!-- never closed <p>a</p>", ""),
        ("<article><nav>only</nav></article>", ""),
        ("<p>" * 300 + "deep" + "<div>" * 300 + "er", "deep\ner"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page, []) == text


def site_page(i: int) -> str:
    return (
        f"<body><div class='brandbar'><p>The Daily Site</p><p>All the best</p></div><div class='story'><p>Story {i} is new</p>"
        f"<p>More of {i} here</p></div><div class='zone'><p>Read this next</p></div></body>"
    )


def test_repeated_branches_go(spark):
    rows = [(i, f"http://a.net/{i}", site_page(i), "x") for i in range(30)]
    rows += [(100, "http://b.net/", site_page(1), "x"), (101, None, site_page(2), "x"), (102, "http://a.net/n", None, "x"), (None, "http://a.net/0", site_page(0), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r["page_id"]: r for r in extract(pages).collect()}
    assert len(found) == len(rows)
    for i in range(30):
        assert found[i]["text"] == f"Story {i} is new\nMore of {i} here"
        assert found[i]["n_chars"] == len(found[i]["text"])
    assert found[None]["text"] == found[0]["text"]
    assert found[100]["text"].startswith("The Daily Site") and found[101]["text"].startswith("The Daily Site")
    assert (found[102]["text"], found[102]["n_chars"]) == ("", 0)
    assert extract(pages.limit(0)).count() == 0
    trees = {r["path"]: r["importance"] for r in site_trees(pages.where("host = 'x' and url like 'http://a%'").withColumn("host", F.lit("a"))).collect()}
    assert trees["html body div.brandbar"] < 0.15 < trees["html body div.story"]


def test_copied_articles_stay(spark):
    page = "<nav>Menu</nav><article><h1>Copied</h1><p>again and again</p></article>"
    pages = spark.createDataFrame([(i, "http://a.net/", page) for i in range(40)], "page_id long, url string, html string")
    assert {r["text"] for r in extract(pages).collect()} == {"Copied\nagain and again"}


def judged_pages(spark, pages):
    rows = [(i, f"http://a.net/{i}", p) for i, p in enumerate(pages)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_the_tree_decides_beside_and_within_articles(spark):
    page = """<nav>Menu</nav><div class="body"><p>Long text {0}</p><section id="discussion"><p>Result {0}</p></section></div>
      <article><p>Read our guide</p></article><div class="ad">Buy {0}</div><footer>Us</footer>"""
    assert judged_pages(spark, [page.format(i) for i in range(20)]) == [f"Long text {i}\nResult {i}" for i in range(20)]
    page = "<article><p>Story {0}</p><ul><li>Follow us</li></ul></article>"
    assert judged_pages(spark, [page.format(i) for i in range(20)]) == [f"Story {i}" for i in range(20)]
    page = "<nav>Menu</nav><aside><p>All that is here {0}</p></aside>"
    assert judged_pages(spark, [page.format(i) for i in range(20)]) == [f"All that is here {i}" for i in range(20)]


@pytest.mark.parametrize("n", [2, 3, 9, 10])
def test_repeated_branches_go_on_small_hosts(spark, n):
    assert judged_pages(spark, [site_page(i) for i in range(n)]) == [f"Story {i} is new\nMore of {i} here" for i in range(n)]


def test_hosts_of_one_page_share_a_tree(spark):
    rows = [(i, f"http://{i}.net/", site_page(i)) for i in range(12)] + [(12, "http://x.net/", "<div class=rare>x</div>")]
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {12: "x", **{i: f"Story {i} is new\nMore of {i} here" for i in range(12)}}


BLOCKS = [
    "<div class='comment'><p>{}</p></div>", "<ol><li class='comment' id='comment-{n}'><p>{}</p></li></ol>", "<div class='reply'><p>{}</p></div>",
    "<div id='discussion'><p>{}</p></div>", "<section id='discussion'><p>{}</p></section>", "<div class='notice'><p>{}</p></div>",
    "<div class='banner'>{}</div>", "<div class='feedback'><p>{}</p></div>", "<div class='related'><a href='/x'>{}</a></div>",
    "<div class='menu'><ul><li>{}</li></ul></div>", "<div class='site-header'>{}</div>", "<div class='search-box'>{}</div>",
]
STORIES = ["<article><h1>Head {n}</h1><p>{}</p></article>", "<div class='story'><h1>Head {n}</h1><p>{}</p></div>"]


def words(pick, n):
    return " ".join(pick.choice("sea ship wind sail mast deck rope harbour light storm wave crew".split()) for _ in range(n))


def test_furniture_with_its_own_text_on_every_page(spark):
    """Beside an article, beside a plain story and within an article: the story stays, the block goes."""
    pick = random.Random(4)
    rows, expected = [], {}
    for k, block in enumerate(BLOCKS):
        for s, story in enumerate([*STORIES, STORIES[0]]):
            for n in range(30):
                text, other = words(pick, 40) + f" {n}", words(pick, 12) + f" of {n}"
                extra = block.format(other, n=n)
                page = story.format(text, n=n)
                page = page.replace("</article>", f"{extra}</article>") if s == 2 else page + extra
                if s == 2 and k == 4:  # a section of the article itself
                    continue
                rows.append((len(rows), f"http://h{k}-{s}.net/{n}", f"<body>{page}</body>"))
                expected[rows[-1][0]] = f"Head {n}\n{text}"
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    wrong = Counter(rows[i][1].split("/")[2] for i in expected if found[i] != expected[i])
    assert wrong == {}


def test_the_same_words_where_they_hold_the_text(spark):
    pick = random.Random(5)
    rows, expected = [], {}
    for k, block in enumerate(BLOCKS):
        if "site-header" in block or "search-box" in block or "<a " in block:
            continue
        for n in range(20):
            text = words(pick, 60) + f" {n}"
            rows.append((len(rows), f"http://h{k}.net/{n}", f"<body><nav><a href='/'>Home</a></nav><div><i>Page {n}</i></div>{block.format(text, n=n)}</body>"))
            expected[rows[-1][0]] = text
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {rows[i][1].split("/")[2] for i in expected if expected[i] not in found[i]} == set()


def test_lists_of_links_weigh_little(spark):
    page = "<div class='story'><p>{0} and so on, a text</p></div><div class='more'><a href='/1'>Read {0} first</a> <a href='/2'>Then {0}</a></div>"
    assert judged_pages(spark, [page.format(i) for i in range(20)]) == [f"{i} and so on, a text" for i in range(20)]
    links = "<ul><li><a href='/{0}'>All about {0}</a></li></ul>"  # a page of links is its links
    assert judged_pages(spark, [links.format(i) for i in range(20)]) == [f"All about {i}" for i in range(20)]


HOSTILE = {
    "nested": lambda n: "<div>" * n + "deep",
    "open": lambda n: "<a " * n + "text",
    "open_quotes": lambda n: "<a \"" * n + ">text",
    "ends": lambda n: "<p>text" + "</b></i></x>" * n,
    "inline": lambda n: "<b>" * n + "<p>x</p>" * n + "text",
    "unclosed": lambda n: "<p><b><i>x" * n + "text",
    "cells": lambda n: "<table>" + "<tr><td><div>x" * n + "text",
    "comments": lambda n: "<!-- x" * n + "--><p>text",
    "classes": lambda n: "<div class='" + "ad-x9 " * n + "'>gone</div><p>text",
    "entities": lambda n: "&#x41;&amp" * n + " text",
    "raw": lambda n: "<script>" * n + "</script><p>text",
    "broken": lambda n: "<a b='>" * n + "text",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_is_linear(name):
    begun = time.perf_counter()
    elements, blocks = parse(HOSTILE[name](100_000))
    assert time.perf_counter() - begun < 20
    assert "text" in " ".join(t for _, t, _ in blocks) or name in ("open", "nested")
    assert max(e.path.count(" ") for e in elements) < site_tree.DEPTH


def test_deep_pages_keep_their_text(spark):
    rows = [(1, "http://a.net/1", "<div>" * 20_000 + "<p>deep</p>"), (2, "http://a.net/2", "<p>short</p>"), (3, None, "<div>" * 20_000 + "deep")]
    rows += [(4 + i, f"http://b.net/{i}", "<b>" * i + f"text {i}") for i in range(60)]
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "deep", 2: "short", 3: "deep"} | {4 + i: f"text {i}" for i in range(60)}


def test_numbered_names_are_one_path(spark):
    page = "<ol class='commentlist'>" + "".join(f"<li class='comment c{{0}}{k}' id='comment-{{0}}{k}'>say {{0}} {k}</li>" for k in range(5)) + "</ol><p>Text {0}</p>"
    counts = []
    for n in (20, 60):
        pages = [(f"{i}", page.format(i)) for i in range(n)]
        df = spark.createDataFrame([("a", p) for _, p in pages], "host string, html string")
        counts.append(site_trees(df).count())
    assert counts[0] == counts[1] < 10


def plain_importance(pages):
    """Own importance of every path of one host, from the entropies as the docstring tells them."""
    styles, texts, chars = defaultdict(Counter), defaultdict(Counter), defaultdict(lambda: [0, 0.0])
    for page in pages:
        elements, blocks = parse(page)
        own = defaultdict(dict)
        for e in elements:
            own[e.path][",".join(e.children)] = None
        for path, children in own.items():
            styles[path]["|".join(children)] += 1
        for path, text, share in {(e.path, t, share) for e, t, share in blocks if not e.hidden}:
            texts[path][text] += 1
            chars[path][0] += len(text)
            chars[path][1] += len(text) * share
    most = max(sum(s.values()) for s in styles.values())
    found = {}
    for path, style in styles.items():
        m = sum(style.values())
        by_style = -sum(c / m * math.log(c / m) for c in style.values()) / math.log(m) if m > 1 else 1.0
        by_text = sum(1 - math.log(c) / math.log(m) for c in texts[path].values()) / len(texts[path]) if texts[path] and m > 1 else float(m == 1)
        seen = max(by_style, by_text) if texts[path] else by_style
        rare = 1 - (1 - site_tree.PRIOR) * m / most
        links = 1 - site_tree.LINKED * (chars[path][1] / chars[path][0] if chars[path][0] else 0)
        found[path] = (m, links * ((m - 1) * seen + rare) / m)
    return found


def test_importance_equals_plain_entropies(spark, folder):
    pages = [r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").limit(25).collect()]
    pages += [site_page(i % 4) for i in range(8)] + ["<div class='story'><a href='x'>Link 1</a> and <b>more</b></div>"]
    own = plain_importance(pages)
    expected = {}
    for path in own:
        below = [(m * site_tree.DECAY ** (p.count(" ") - path.count(" ")), v) for p, (m, v) in own.items() if p == path or p.startswith(path + " ")]
        expected[path] = sum(w * v for w, v in below) / sum(w for w, _ in below)
    df = spark.createDataFrame([("a", p) for p in pages], "host string, html string").repartition(3)
    found = {r["path"]: r["importance"] for r in site_trees(df).collect()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[p], expected[p], abs_tol=1e-9) for p in found)


def test_counts_of_a_site_are_those_of_its_pages(spark):
    df = spark.createDataFrame([("a", site_page(i % 3)) for i in range(9)], "host string, html string")
    named = df.withColumns({"page_id": F.lit(0).cast("long"), "url": F.lit("u")})
    values = site_values(parsed(named)).collect()
    story = [r for r in values if r["path"] == "html body div.story p" and r["is_text"]]
    assert len(story) == 6 and {r["c"] for r in story} == {3}
