"""Pages as tables of nodes, read from the positions of their tags, and the cards that repeat in them.

A node is a row with its parent, its depth, and where its subtree ends in document order, so a
subtree is a range of node numbers. Hashes of subtrees and what subtrees hold are found where a
page is read, in time that follows the page's length at any depth: no job a level, no path a node.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolved
from .trees import card_texts

#: Elements that have no content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title")
#: Roles of things that are operated, and data attributes that only track.
CARD_ROLES = frozenset("article button link listitem".split())
TRACKING_DATA = frozenset("data-hd data-hveid data-lht data-ved".split())
NEAR = 12  # ancestors a node lists, the nearest first

_MARK = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9-]*)\b([^<>]*)>|<![^<>]*>")
_PAIR = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _PAIR.finditer(text)}


def is_marker(attributes: dict[str, str]) -> bool:
    """Whether an element says itself that it is one of a list of things to operate."""
    return attributes.get("role", "").strip().lower() in CARD_ROLES or any(a.startswith("data-") and a not in TRACKING_DATA for a in attributes)


def read_nodes(page: str | None) -> list[dict]:
    """The elements of a page in document order; closing tags that close nothing are skipped, open ones end with what is around them."""
    page = page or ""
    ends = {t: [m.start() for m in re.finditer(rf"</{t}\s*>", page, re.I)] for t in RAW}
    nodes: list[dict] = []
    open_: list[int] = []
    depth_of: dict[str, int] = {}  # how many of a tag are open
    at, said = 0, 0

    def text_until(stop: int) -> None:
        if open_ and stop > said:
            nodes[open_[-1]]["_text"].append(page[said:stop])

    while m := _MARK.search(page, at):
        text_until(m.start())
        at = said = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = said = len(page) if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if depth_of.get(tag):
                while True:
                    top = open_.pop()
                    nodes[top]["stop"] = len(nodes)
                    depth_of[nodes[top]["tag"]] -= 1
                    if nodes[top]["tag"] == tag:
                        break
            continue
        me, parent = len(nodes), open_[-1] if open_ else None
        order = 0
        if parent is not None:
            order = nodes[parent]["n_children"]
            nodes[parent]["n_children"] += 1
        above = [] if parent is None else [parent, *nodes[parent]["above"][: NEAR - 1]]
        nodes.append({"node": me, "parent": parent, "ord": order, "depth": len(open_), "stop": me + 1, "tag": tag, "n_children": 0, "attributes": _attributes(m[3]), "above": above, "_text": []})
        if tag in RAW:
            i = bisect_left(ends[tag], at)
            end = ends[tag][i] if i < len(ends[tag]) else len(page)
            nodes[me]["_text"].append(page[at:end])
            at = said = page.find(">", end) + 1 or len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(me)
            depth_of[tag] = depth_of.get(tag, 0) + 1
    text_until(len(page))
    for i in open_:
        nodes[i]["stop"] = len(nodes)
    return finished(nodes)


def finished(nodes: list[dict]) -> list[dict]:
    """Nodes with their own text, both hashes, and their subtrees' text length, links and markers; children come after parents, so the last come first."""
    inner: list[list[tuple[str, str]]] = [[] for _ in nodes]
    for n in reversed(nodes):
        me = n["node"]
        n["text"] = " ".join(entities.unescape("".join(n.pop("_text"))).split())
        hidden = n["tag"] in ("script", "style")
        classes = "".join(sorted(set(n["attributes"].get("class", "").split())))
        kids = inner[me][::-1]
        n["plain"] = hashlib.md5(f"{n['tag']}:{n['n_children']}[{''.join(k[0] for k in kids)}]".encode()).hexdigest()
        n["classed"] = hashlib.md5(f"{n['tag']}{classes}{''.join(k[1] for k in kids)}".encode("utf-8", "surrogatepass")).hexdigest()
        n["chars"] = n.get("chars", 0) + (0 if hidden else len(n["text"]))
        n["links"] = n.get("links", 0) + (n["tag"] == "a" and "href" in n["attributes"])
        n["marked"] = n.get("marked", False) or is_marker(n["attributes"])
        inner[me] = []
        if n["parent"] is not None:
            up = nodes[n["parent"]]
            inner[n["parent"]].append((n["plain"], n["classed"]))
            for c in ("chars", "links"):
                up[c] = up.get(c, 0) + n[c]
            up["marked"] = up.get("marked", False) or n["marked"]
    return nodes


NODES = "node int, parent int, ord int, depth int, stop int, tag string, n_children int, attributes map<string,string>, above array<int>, text string, plain string, classed string, chars long, links long, marked boolean"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_COLUMNS = dict(c.split() for c in NODES.split(", "))
SLICE = 16  # pages whose nodes are held at a time, as they are many times their rows


def parsed(pages: DataFrame, page: str, html: str, columns: list[str] | None = None) -> DataFrame:
    """A row an element of every page, with some ``columns`` of NODES or all; a page without elements, or a null one, has none."""
    names = columns or list(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                of, own = [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    nodes = read_nodes(text)
                    own += nodes
                    of += [i] * len(nodes)
                if own:
                    values = [pa.array([list(n[c].items()) if c == "attributes" else n[c] for n in own], _KINDS[_COLUMNS[c]]) for c in names]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), *values], names=[page, *names])

    return pages.select(page, html).mapInArrow(run, f"`{page}` {dict(pages.dtypes)[page]}, " + ", ".join(f"{c} {_COLUMNS[c]}" for c in names))


def card_like(least: int = 10, most: int = 2000) -> Column:
    """Whether a node may be a card: it holds some text, not too much, and a link or a marker."""
    return ~F.col("tag").isin("html", "head", "body", "script", "style", "a") & F.col("chars").between(least, most) & ((F.col("links") >= 1) | F.col("marked")) & (F.col("n_children") >= 1)


def best_cards(nodes: DataFrame, page: str, guard: Column | None = None) -> DataFrame:
    """The nodes of each page's best group of candidates of one structure: of two or more members, by the
    share of members with a marker, then their number, then their mean text length, then the first that begins.
    """
    own = nodes.where(card_like() if guard is None else guard)
    groups = own.groupBy(page, "classed").agg(F.count("*").alias("size"), F.avg(F.col("marked").cast("double")).alias("share"), F.avg("chars").alias("mean"), F.min("node").alias("first")).where("size >= 2")
    best = groups.groupBy(page).agg(F.max_by("classed", F.struct("share", "size", "mean", -F.col("first"))).alias("classed"))
    return own.join(best, [page, "classed"])


def climbed(cards: DataFrame, page: str) -> DataFrame:
    """page, levels: how many steps up all of a page's cards stay apart, NEAR at most; beyond its last ancestor a card stays where it is."""
    hops = F.explode(F.sequence(F.lit(0), F.lit(NEAR)))
    up = F.when(F.col("hop") == 0, F.col("node")).otherwise(F.coalesce(F.get("above", F.least(F.col("hop"), F.size("above")) - 1), F.col("node")))
    per = cards.select(page, "node", "above", hops.alias("hop")).withColumn("up", up).groupBy(page, "hop").agg((F.count_distinct("up") == F.count("*")).alias("apart"))
    first = per.where(~F.col("apart")).groupBy(page).agg(F.min("hop").alias("stop"))
    return per.select(page).distinct().join(first, page, "left").select(page, F.coalesce(F.col("stop") - 1, F.lit(NEAR)).alias("levels"))


def page_cards(pages: DataFrame, page: str, html: str, url: str, keep) -> DataFrame:
    """page, node, root, title, company, location and link of each page's cards.

    ``root`` is the card climbed up as far as all of the page's cards stay apart; texts and the
    first link are those of the root's subtree. ``keep(frame, name)`` writes the nodes once.
    """
    nodes = keep(parsed(pages, page, html), "nodes")
    cards = best_cards(nodes, page)
    levels = climbed(cards, page)
    root = F.when(F.col("levels") == 0, F.col("node")).otherwise(F.coalesce(F.get("above", F.least("levels", F.size("above")) - 1), F.col("node")))
    roots = cards.join(levels, page).select(page, F.col("node").alias("_card"), root.alias("root"))
    ends = nodes.select(page, F.col("node").alias("root"), F.col("stop").alias("_stop"))
    spans = roots.join(ends, [page, "root"]).alias("c")
    # a page's nodes meet a page's cards; the range keeps those of the card's own subtree
    held = nodes.alias("n").join(spans, (F.col(f"n.{page}") == F.col(f"c.{page}")) & (F.col("n.node") >= F.col("c.root")) & (F.col("n.node") < F.col("c._stop")))
    held = held.select(F.struct(F.col(f"c.{page}").alias("page"), F.col("c._card").alias("node"), F.col("c.root").alias("root")).alias("card"), F.col("n.node").alias("ord"), "n.tag", F.col("n.attributes")["role"].alias("role"), "n.text", F.lit(0.0).alias("height"), F.col("n.attributes")["href"].alias("href"))
    texts = card_texts(held, "card")
    links = held.where("href <> ''").groupBy("card").agg(F.min_by("href", "ord").alias("href"))
    out = texts.join(links, "card", "left").select(F.col("card.page").alias(page), "card.node", "card.root", "title", "company", "location", "href")
    return out.join(pages.select(page, url), page).select(page, "node", "root", "title", "company", "location", resolved(F.col("href"), F.col(url)).alias("link"))
