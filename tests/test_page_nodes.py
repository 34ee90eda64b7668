"""Nodes of pages, their hashes and cards, against brute force on small pages; deep pages in linear time."""

import collections
import hashlib
import random
import time

from sparkloom.operators import page_nodes, trees


def test_nodes_in_document_order():
    nodes = page_nodes.read_nodes("<div><p>a<br>b</p><p>c<br></p><ul><li>x<li>y</ul></div>")
    assert [(n["tag"], n["depth"]) for n in nodes] == [("div", 0), ("p", 1), ("br", 2), ("p", 1), ("br", 2), ("ul", 1), ("li", 2), ("li", 3)]
    assert [n["stop"] for n in nodes] == [8, 3, 3, 5, 5, 8, 8, 8] and nodes[1]["text"] == "ab"
    assert page_nodes.read_nodes(None) == [] and page_nodes.read_nodes("<" * 1000) == []
    odd = page_nodes.read_nodes("<!DOCTYPE x><a HREF='/q?a&amp;b' data-x checked>t&eacute;<script>if (a<b) '<p>'</script><!-- <i> --></b></a><img/>z")
    assert [(n["tag"], n["text"], n["links"], n["marked"]) for n in odd] == [("a", "té", 1, True), ("script", "if (a<b) '<p>'", 0, False), ("img", "", 0, False)]
    assert odd[0]["attributes"] == {"href": "/q?a&b", "data-x": "", "checked": ""} and odd[0]["chars"] == 2


def test_deep_and_hostile_pages_take_linear_time():
    for page in ("<div>" * 30_000 + "x", "<p " * 100_000, "<script>" * 50_000, "<!--" * 50_000, "<b></i>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000):
        began = time.perf_counter()
        page_nodes.read_nodes(page)
        assert time.perf_counter() - began < 5


def page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "ul", "li", "p", "span"])
        attrs = rng.choice(["", "", " class='b a'", " class='c'", " data-id=7", " role=listitem"])
        inner = page(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else rng.choice(["some words here", "<a href=/x>link</a>", "x<br>y"])
        out += f"<{tag}{attrs}>{inner}</{tag}>" * rng.choice([1, 1, 2, 3])
    return out


def test_hashes_equal_those_of_the_level_by_level_operator(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, page(rng)) for i in range(12)] + [(98, ""), (99, None)], "page long, html string")
    nodes = page_nodes.parsed(frame, "page", "html").select("page", "node", "parent", "ord", "depth", "tag", "plain")
    want = {(r["page"], r["node"]): r["hash"] for r in trees.structural_hashes(nodes, "page", trees.plain_base(), lambda f, _: f).collect()}
    got = {(r["page"], r["node"]): r["plain"] for r in nodes.collect()}
    assert got == want and len(got) > 50


def brute(html):
    """The best group of a page, by walking each candidate's subtree."""
    nodes = page_nodes.read_nodes(html)
    kids = collections.defaultdict(list)
    for n in nodes:
        kids[n["parent"]].append(n)

    def under(n):
        return [n, *(x for k in kids[n["node"]] for x in under(k))]

    def shape(n):
        own = n["tag"] + "".join(sorted(set(n["attributes"].get("class", "").split()))) + "".join(shape(k) for k in kids[n["node"]])
        return hashlib.md5(own.encode()).hexdigest()

    groups = collections.defaultdict(list)
    for n in nodes:
        own = under(n)
        chars, links = sum(len(x["text"]) for x in own), sum(x["tag"] == "a" for x in own)
        marked = any(page_nodes.is_marker(x["attributes"]) for x in own)
        if n["tag"] != "a" and 10 <= chars <= 2000 and (links or marked) and kids[n["node"]]:
            groups[shape(n)].append((n["node"], marked, chars))
    best = max(((sum(m for _, m, _ in g) / len(g), len(g), sum(c for *_, c in g) / len(g), -g[0][0], g) for g in groups.values() if len(g) > 1), default=None)
    return nodes, [n for n, *_ in best[4]] if best else []


def test_cards_against_brute_force(spark):
    rng = random.Random(5)
    pages = [(i, page(rng), "https://x.org/d/e") for i in range(40)] + [(90, None, "https://x.org/"), (91, "<p>no cards", None)]
    keep = lambda f, _: f
    nodes = page_nodes.parsed(spark.createDataFrame(pages, "page long, html string, url string"), "page", "html")
    got = collections.defaultdict(list)
    for r in page_nodes.best_cards(nodes, "page").select("page", "node").collect():
        got[r["page"]].append(r["node"])
    want = {k: cards for k, html, _ in pages for _, cards in [brute(html)] if cards}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 10
    levels = {r["page"]: r["levels"] for r in page_nodes.climbed(page_nodes.best_cards(nodes, "page"), "page").collect()}
    roots = {}
    for k, html, _ in pages:
        tree, cards = brute(html)
        at, hop = list(cards), 0
        while cards and hop < 12:
            up = [tree[c]["above"][hop] if hop < len(tree[c]["above"]) else c for c in cards]
            if len(set(up)) < len(up):
                break
            at, hop = up, hop + 1
        if cards:
            assert levels[k] == hop
            roots[k] = dict(zip(cards, at))
    out = page_nodes.page_cards(spark.createDataFrame(pages, "page long, html string, url string"), "page", "html", "url", keep).collect()
    assert {(r["page"], r["node"], r["root"]) for r in out} == {(k, c, x) for k, own in roots.items() for c, x in own.items()}
    assert all(r["link"] in (None, "https://x.org/x") for r in out) and any(r["link"] for r in out)


def test_titles_and_links_of_cards(spark):
    html = "<ul>" + "".join(f"<li class=card><div><h3>Job {i}</h3><span>Firm {i}</span><span>Town</span><a href='/j/{i}'>see</a></div></li>" for i in range(3)) + "</ul>"
    got = page_nodes.page_cards(spark.createDataFrame([(1, html, "https://x.org/l")], "p long, h string, u string"), "p", "h", "u", lambda f, _: f).collect()
    assert sorted((r["title"], r["company"], r["location"], r["link"]) for r in got) == [(f"Job {i}", f"Firm {i}", "Town", f"https://x.org/j/{i}") for i in range(3)]


def test_some_columns_of_nodes(spark):
    rows = spark.createDataFrame([(i, f"<div id='a{i}'><p>x</p></div>" if i % 5 else None) for i in range(3 * page_nodes.SLICE)], "k long, h string")
    whole = page_nodes.parsed(rows, "k", "h")
    some = page_nodes.parsed(rows, "k", "h", ["node", "attributes", "plain"])
    assert some.columns == ["k", "node", "attributes", "plain"]
    key = lambda r: (r["k"], r["node"])
    assert sorted(some.collect(), key=key) == sorted(whole.select(*some.columns).collect(), key=key) and some.count() == 2 * rows.where("h is not null").count()
