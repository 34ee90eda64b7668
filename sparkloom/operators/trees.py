"""Page trees as tables of nodes: structural hashes, distances, geometry, occlusion, traps, field types, forms and cards.

A node is a row (page, node, parent, ord, depth, path, tag, and attributes or boxes where they are
known); ``path`` lists its ancestors from the root to itself. A page is the unit that all pairs of
nodes stay within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def structural_hashes(nodes: DataFrame, page: str, base: Column, keep, brackets: bool = True) -> DataFrame:
    """``nodes`` with n_children and hash: md5 of the node's base and its children's hashes in order, level by level from the deepest.

    ``base`` may use n_children. ``keep(frame, name)`` writes a level and reads it back, so the
    plan stays one level deep; each level is aggregated by page and parent, never by page alone.
    """
    counts = nodes.where("parent is not null").groupBy(page, F.col("parent").alias("node")).agg(F.count("*").cast("int").alias("n_children"))
    rows = keep(nodes.join(counts, [page, "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("_base", base), "nodes")
    deepest = rows.agg(F.max("depth")).first()[0]
    done = below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.where(F.col("depth") == depth)
        inner = F.lit("")
        if below is not None:
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda c: c["hash"]), "")
            level = level.join(below.groupBy(page, F.col("parent").alias("node")).agg(joined.alias("_inner")), [page, "node"], "left")
            inner = F.coalesce("_inner", F.lit(""))
        text = F.concat("_base", F.lit("["), inner, F.lit("]")) if brackets else F.concat("_base", inner)
        below = keep(level.withColumn("hash", F.md5(text.cast("binary"))).select(*rows.columns, "hash"), f"level-{depth}")
        done = below if done is None else done.unionByName(below)
    return (done if done is not None else rows.withColumn("hash", F.lit(None).cast("string"))).drop("_base")


def plain_base() -> Column:
    """A node's tag and number of children."""
    return F.concat("tag", F.lit(":"), F.col("n_children").cast("string"))


def classed_base(classes: Column) -> Column:
    """A node's tag and its classes in order."""
    return F.concat("tag", F.array_join(F.array_sort(F.filter(F.split(F.coalesce(classes, F.lit("")), "\\s+"), lambda c: c != "")), ""))


def repeated_subtrees(hashed: DataFrame, page: str, least: int = 2) -> DataFrame:
    """Nodes with children whose hash occurs ``least`` times or more in their page, with the number of times; scripts and styles don't count."""
    own = hashed.where((F.col("n_children") >= 1) & ~F.col("tag").isin("script", "style"))
    often = own.groupBy(page, "hash").agg(F.count("*").alias("times")).where(F.col("times") >= least)
    return own.join(often, [page, "hash"])


def tree_distance(a: Column, b: Column) -> Column:
    """Edges between two nodes of a tree, from their paths; a million where they share no root."""
    n = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.when(same == 0, 1_000_000).otherwise(F.size(a) + F.size(b) - 2 * same)


def centre(box: Column) -> tuple[Column, Column]:
    return box["x"] + box["w"] / 2, box["y"] + box["h"] / 2


def box_distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def covers(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["x"], box["x"] + box["w"]) & y.between(box["y"], box["y"] + box["h"])


def transformed(x: Column, y: Column, matrix: tuple[float, ...], cx: Column, cy: Column) -> tuple[Column, Column]:
    """A point under a matrix (a, b, c, d, e, f) about a centre."""
    a, b, c, d, e, f = matrix
    dx, dy = x - cx, y - cy
    return a * dx + c * dy + e + cx, b * dx + d * dy + f + cy


def _crosses(x: Column, y: Column, p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    """Whether the edge from p to q lies right of a point at its height."""
    (px, py), (qx, qy) = p, q
    level = (F.least(py, qy) < y) & (y <= F.greatest(py, qy)) & (x <= F.greatest(px, qx))
    at = F.try_divide((y - py) * (qx - px), qy - py) + px
    return F.coalesce(level & ((px == qx) | (x <= at)), F.lit(False))


def in_polygon(x: Column, y: Column, corners: Column | list[tuple[Column, Column]]) -> Column:
    """Whether a point lies inside a polygon by the even-odd rule: an array of x, y, or, where their number is known, pairs of columns.

    Pairs are compiled; each corner of an array is bound once, as a function in it would be worked out anew at every use.
    """
    if isinstance(corners, list):
        crossings = [_crosses(x, y, p, q).cast("int") for p, q in zip(corners, [*corners[1:], *corners[:1]], strict=True)]
        return sum(crossings[1:], crossings[0]) % 2 == 1
    after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    crossings = F.zip_with(corners, after, lambda p, q: _crosses(x, y, (p["x"], p["y"]), (q["x"], q["y"])))
    return F.size(F.filter(crossings, lambda c: c)) % 2 == 1


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points, counter-clockwise from the leftmost; all distinct points where there are two or fewer."""
    p = np.unique(points, axis=0)
    if len(p) <= 2:
        return p

    def chain(rows: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append([x, y])
        return out

    return np.array(chain(p.tolist())[:-1] + chain(p[::-1].tolist())[:-1])


def hulls(points: DataFrame, group: str, x: str, y: str, salts: int = 16) -> DataFrame:
    """group and corners of the convex hull of each group's points: hulls of salted parts first, then the hull of their corners."""
    kind = dict(points.dtypes)[group]
    rows = points.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()

    def part(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(hull(f[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(**{group: f[group].iloc[0]})[[group, "x", "y"]]

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        corners = [{"x": float(a), "y": float(b)} for a, b in hull(f[["x", "y"]].to_numpy())]
        return pd.DataFrame({group: f[group].iloc[:1].to_list(), "corners": [corners]})

    some = rows.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).groupBy(group, "_salt").applyInPandas(part, f"`{group}` {kind}, x double, y double")
    return some.groupBy(group).applyInPandas(whole, f"`{group}` {kind}, corners array<struct<x:double,y:double>>")


def hull_distance(a: Column, b: Column) -> Column:
    """The least distance between corners of two hulls."""
    each = F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))))
    return F.sqrt(F.array_min(each))


def occluded(nodes: DataFrame, page: str) -> DataFrame:
    """page, node and the first node (in paint order) that covers its centre from above; only nodes that are covered.

    ``nodes`` has node, ord (paint order), box, z, path and clickable. Above is a greater z, or the
    same and later; a node's own descendants don't cover it. Boxes meet in cells of a grid, so a
    page's nodes are not all paired.
    """
    size = 256.0
    cells = lambda lo, extent: F.sequence(F.floor(lo / size), F.floor((lo + extent) / size))
    over = nodes.where("clickable and box.w * box.h > 0").select(page, F.col("node").alias("by"), F.col("ord").alias("by_ord"), F.col("box").alias("by_box"), F.col("z").alias("by_z"), F.col("path").alias("by_path"))
    over = over.withColumn("cx", F.explode(cells(F.col("by_box.x"), F.col("by_box.w")))).withColumn("cy", F.explode(cells(F.col("by_box.y"), F.col("by_box.h"))))
    x, y = centre(F.col("box"))
    under = nodes.select(page, "node", "ord", "z", x.alias("x"), y.alias("y"), F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))
    pairs = under.join(over, [page, "cx", "cy"]).where((F.col("by") != F.col("node")) & covers(F.col("by_box"), F.col("x"), F.col("y")))
    above = (F.col("by_z") > F.col("z")) | ((F.col("by_z") == F.col("z")) & (F.col("by_ord") > F.col("ord")))
    hit = pairs.where(above & ~F.array_contains("by_path", F.col("node")))
    return hit.groupBy(page, "node").agg(F.min_by("by", "by_ord").alias("covered_by"))


#: Parts of names that traps have.
TRAP_NAMES = ["fax", "confirm_email", "email2", "extra", "hidden", "url2", "phone2", "address2", "captcha", "verification", "validate", "test"]
TRAP_NAMES_2 = ["fax", "confirm_email", "extra", "hidden", "url2", "email2"]


def _holds(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.coalesce(F.lower(text).contains(w), F.lit(False))
    return hit


def trap_reason(box: Column, names: Column, hidden_ancestor: Column, labelled: Column) -> Column:
    """Why an input is likely a trap, the first of size, place, name, a hidden ancestor and no label; null for none."""
    area = box["w"] * box["h"]
    return (
        F.when((box["w"] <= 0) | (box["h"] <= 0), "zero size").when(area < 4, "too small").when((box["x"] < -1000) | (box["y"] < -1000), "offscreen")
        .when(_holds(names, TRAP_NAMES), "name").when(hidden_ancestor, "hidden ancestor").when(~labelled, "no label")
    )


def hidden_ancestors(nodes: DataFrame, page: str) -> DataFrame:
    """page and node of the nodes with an ancestor of no size."""
    gone = nodes.where("box.w <= 0 or box.h <= 0").select(page, F.col("node").alias("up"))
    each = nodes.select(page, "node", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("up"))
    return each.join(gone, [page, "up"], "left_semi").select(page, "node").distinct()


def segmented_traps(nodes: DataFrame, page: str, reach: float = 300.0) -> DataFrame:
    """page, node, trap for inputs: not visible, offscreen, named like a trap, or with neither placeholder nor a text's centre within ``reach``."""
    cell = lambda c: F.floor(c / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    tx, ty = centre(F.col("box"))
    text = nodes.where("has_text").select(page, F.col("node").alias("other"), tx.alias("tx"), ty.alias("ty"))
    text = text.withColumn("cx", around(F.col("tx"))).withColumn("cy", around(F.col("ty")))
    inputs = nodes.where("is_input")
    x, y = centre(F.col("box"))
    near = inputs.select(page, "node", x.alias("x"), y.alias("y"), cell(x).alias("cx"), cell(y).alias("cy")).join(text, [page, "cx", "cy"])
    near = near.where((F.abs(F.col("x") - F.col("tx")) <= reach) & (F.abs(F.col("y") - F.col("ty")) <= reach) & (F.col("other") != F.col("node")))
    near = near.select(page, "node").distinct().withColumn("_near", F.lit(True))
    box = F.col("box")
    hidden = (box["w"] <= 0) | (box["h"] <= 0) | (box["w"] * box["h"] < 1)
    bare = ~F.col("placeholder") & F.col("_near").isNull()
    trap = hidden | (box["x"] < -1000) | (box["y"] < -1000) | _holds(F.col("name"), TRAP_NAMES_2) | bare
    return inputs.join(near, [page, "node"], "left").select(page, "node", trap.alias("trap"))


#: Words of field types, in the order in which ties are decided.
FIELD_WORDS = {
    "email": ["email", "e-mail", "mail"], "telephone": ["phone", "tel", "mobile", "cell", "contact"], "first_name": ["first", "given", "forename"], "last_name": ["last", "surname", "family"],
    "full_name": ["full name", "your name", "name"], "street_address": ["address", "street", "addr"], "city": ["city", "town"], "state": ["state", "province", "region"],
    "zip_code": ["zip", "postal", "postcode", "pin"], "country": ["country", "nation"], "linkedin_url": ["linkedin"], "github_url": ["github"], "portfolio_url": ["portfolio", "website", "url"],
    "work_authorization": ["authorized", "eligible", "work authorization"], "sponsorship": ["sponsor", "visa", "sponsorship"], "gender": ["gender", "sex"], "race": ["race", "ethnicity"],
    "veteran": ["veteran", "military"], "disability": ["disability", "disabled"], "resume_upload": ["resume", "cv", "curriculum"], "cover_letter_upload": ["cover letter", "cover"],
}
#: What each place of evidence weighs.
FIELD_WEIGHTS = {"autocomplete": 15, "name": 12, "id": 12, "placeholder": 10, "aria": 8, "label": 10}


def field_scores(texts: dict[str, Column]) -> Column:
    """An array of (score, type) over the field types that any text's words support: each place of evidence counts its weight once a type."""
    out = []
    for kind, words in FIELD_WORDS.items():
        score = sum((F.when(_holds(x, words), FIELD_WEIGHTS[place]).otherwise(0) for place, x in texts.items()), F.lit(0))
        out.append(F.struct(score.alias("score"), F.lit(kind).alias("kind")))
    return F.filter(F.array(*out), lambda s: s["score"] > 0)


def best_type(scores: Column) -> Column:
    """The type of the greatest score, of equal ones the first; "text" without any."""
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.coalesce(F.get(F.filter(scores, lambda s: s["score"] == top), F.lit(0))["kind"], F.lit("text"))


def segmented_type(kind: Column, all_text: Column, name: Column, is_select: Column) -> Column:
    """The second scorer: fixed points per type over all the texts of an input together; the first of equal scores, else by the input's kind."""
    has = lambda *w: F.greatest(*(F.coalesce(F.lower(all_text).contains(x), F.lit(False)) for x in w), F.lit(False))
    file = F.coalesce(kind == "file", F.lit(False))
    points = [
        ("email", F.when((kind == "email") | has("email"), 20).otherwise(0) + F.when(has("e-mail") | F.lower(name).contains("email"), 10).otherwise(0)),
        ("telephone", F.when((kind == "tel") | has("phone", "mobile"), 20)), ("first_name", F.when(has("first") & has("name"), 25)), ("last_name", F.when(has("last") & has("name"), 25)),
        ("full_name", F.when(has("full", "your name") & has("name"), 20)), ("street_address", F.when(has("address"), 15)), ("city", F.when(has("city"), 20)),
        ("state", F.when(has("state", "province"), 20)), ("zip_code", F.when(has("zip", "postal"), 20)), ("resume_upload", F.when(file & has("resume", "cv"), 30)),
        ("cover_letter_upload", F.when(file & ~has("resume", "cv") & has("cover"), 30)), ("linkedin_url", F.when(has("linkedin"), 25)), ("github_url", F.when(has("github"), 25)),
        ("portfolio_url", F.when(has("portfolio", "website"), 20)), ("work_authorization", F.when(has("authorized", "eligibility"), 15)), ("sponsorship", F.when(has("sponsor"), 15)),
        ("select", F.when(is_select, 10)),
    ]
    scores = F.filter(F.array(*(F.struct(F.coalesce(p, F.lit(0)).alias("score"), F.lit(k).alias("kind")) for k, p in points)), lambda s: s["score"] > 0)
    plain = F.when(kind == "email", "email").when(kind == "tel", "telephone").when(file, "resume_upload").otherwise("text")
    return F.when(F.size(scores) > 0, best_type(scores)).otherwise(plain)


def form_containers(nodes: DataFrame, page: str, least: int = 2) -> DataFrame:
    """page and node of the nearest ancestors that hold ``least`` inputs or more and do not overlap: the deepest first.

    A container is taken if none of its descendants holds as many.
    """
    up = nodes.where("is_input").select(page, F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("node"))
    counts = up.groupBy(page, "node").agg(F.count("*").alias("inputs")).where(F.col("inputs") >= least)
    placed = counts.join(nodes.select(page, "node", "path"), [page, "node"])
    inner = placed.select(page, F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("node")).distinct()
    return placed.join(inner, [page, "node"], "left_anti").select(page, "node", "inputs")


#: Parts of attribute names that track or number, and the shares an identity needs.
TRACKING_HINTS = ["ved", "hveid", "lht", "-hd", "bm", "eid", "trace", "nonce"]
POSITION_HINTS = ["index", "pos", "idx", "order", "tabindex"]
LEAST_PRESENT, LEAST_DISTINCT, LEAST_UNIQUE = 0.6, 0.6, 0.8


def identity_attributes(cards: DataFrame, page: str, every: DataFrame) -> DataFrame:
    """page and name of attributes that tell a page's cards apart: present, distinct and unique in the page often enough, not tracking or positional.

    ``cards`` and ``every`` have name and value rows, one per attribute of a card or of any node;
    ``cards`` has node too.
    """
    total = cards.groupBy(page).agg(F.count_distinct("node").alias("cards"))
    uses = every.where("value <> ''").groupBy(page, "name", "value").agg(F.count("*").alias("uses"))
    own = cards.where(F.trim("value") != "").join(uses, [page, "name", "value"])
    per = own.groupBy(page, "name").agg(F.count("*").alias("present"), F.count_distinct("value").alias("kinds"), F.count_if(F.col("uses") == 1).alias("unique"))
    low = F.lower("name")
    hinted = F.lit(False)
    for h in (*TRACKING_HINTS, *POSITION_HINTS):
        hinted = hinted | low.contains(h)
    two = lambda x: F.greatest(F.lit(2), F.floor(x))
    fine = (F.col("present") >= two(LEAST_PRESENT * F.col("cards"))) & (F.col("kinds") > 1) & ~hinted & (F.col("kinds") >= two(LEAST_DISTINCT * F.col("present"))) & (F.col("unique") / F.col("present") >= LEAST_UNIQUE)
    return per.join(total, page).where(fine).select(page, "name")


def card_levels(cards: DataFrame, page: str, most: int = 12) -> DataFrame:
    """page and levels: how many steps up all of a page's cards stay apart, ``most`` at most.

    ``cards`` has path. Step k is held by a card's k-th ancestor (its root beyond that).
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(most)))
    each = cards.select(page, "path", step.alias("hop")).withColumn("up", F.element_at("path", F.greatest(F.size("path") - F.col("hop"), F.lit(1))))
    per = each.groupBy(page, "hop").agg((F.count_distinct("up") == F.count("*")).alias("apart"))
    first = per.where(~F.col("apart")).groupBy(page).agg(F.min("hop").alias("stop"))
    return per.select(page).distinct().join(first, page, "left").select(page, F.coalesce(F.col("stop") - 1, F.lit(most)).alias("levels"))


def card_texts(nodes: DataFrame, card: str) -> DataFrame:
    """card, title, company and location: the heading of the greatest score (height and a tenth of its length, 60 at most), and the first two other texts.

    ``nodes`` has a row per node of a card with ord, tag, role, text and height.
    """
    words = nodes.withColumn("_text", F.trim("text")).where("_text <> ''")
    heading = F.col("tag").rlike("^h[1-6]$") | (F.lower(F.trim(F.coalesce("role", F.lit("")))) == "heading")
    score = F.coalesce("height", F.lit(0.0)) + F.least(F.length("_text"), F.lit(60)) / 10
    titles = words.where(heading & (score > 0)).groupBy(card).agg(F.max_by("_text", F.struct(score, -F.col("ord"))).alias("title"))
    rest = words.where(~F.col("tag").isin("script", "style")).join(titles, card, "left").where(F.col("title").isNull() | (F.col("_text") != F.col("title")))
    two = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_text"))), lambda r: r["_text"]), 1, 2)
    others = rest.groupBy(card).agg(two.alias("two"))
    out = nodes.select(card).distinct().join(titles, card, "left").join(others, card, "left")
    return out.select(card, F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.get("two", F.lit(0)), F.lit("")).alias("company"), F.coalesce(F.get("two", F.lit(1)), F.lit("")).alias("location"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost matrix its column in an assignment of least total cost, -1 where there are more rows than columns.

    Shortest augmenting paths with potentials, each step over all columns at once.
    """
    n, m = cost.shape
    if n > m:
        back = assignment(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, before, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, far = row, -1, 0.0
        while at >= 0:
            step = far + cost[at] - u[at] - v
            better = ~seen & (step < reach)
            reach[better], before[better] = step[better], column
            column = int(np.where(seen, np.inf, reach).argmin())
            seen[column], far, at = True, reach[column], owner[column]
        done = np.flatnonzero(seen & (owner >= 0))
        u[row] += far
        u[owner[done]] += far - reach[done]
        v[seen] -= far - reach[seen]
        while column >= 0:
            nearer = before[column]
            owner[column] = owner[nearer] if nearer >= 0 else row
            column = nearer
    out = np.full(n, -1)
    held = np.flatnonzero(owner >= 0)
    out[owner[held]] = held
    return out


def assigned(cost: list[list[float]]) -> list[int]:
    """``assignment`` of a small matrix of finite costs without more rows than columns, step by step the same, in lists."""
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for row in range(n):
        reach, before, left = [np.inf] * m, [-1] * m, list(range(m))
        at, column, far = row, -1, 0.0
        while at >= 0:
            own, less, least, near = cost[at], u[at], np.inf, -1
            for j in left:
                step = far + own[j] - less - v[j]
                if step < reach[j]:
                    reach[j], before[j] = step, column
                if reach[j] < least:
                    least, near = reach[j], j
            left.remove(near)
            column, far, at = near, least, owner[near]
        u[row] += far
        for j in set(range(m)).difference(left):
            if owner[j] >= 0:
                u[owner[j]] += far - reach[j]
            v[j] -= far - reach[j]
        while column >= 0:
            nearer = before[column]
            owner[column] = owner[nearer] if nearer >= 0 else row
            column = nearer
    out = [-1] * n
    for j, k in enumerate(owner):
        if k >= 0:
            out[k] = j
    return out


def _solved(cost: np.ndarray) -> np.ndarray:
    if cost.size > 256 or not np.isfinite(cost).all():
        return assignment(cost)
    if cost.shape[0] <= cost.shape[1]:
        return np.array(assigned(cost.tolist()))
    out = np.full(len(cost), -1)
    out[assigned(cost.T.tolist())] = np.arange(cost.shape[1])
    return out


#: Pairs of inputs and labels whose costs are computed together.
PAIRS = 500_000


class _Nodes:
    """The inputs and labels of an Arrow batch's pages, laid end to end in the order of page and node."""

    def __init__(self, pages: pa.ListArray):
        flat = pages.flatten()
        row = np.repeat(np.arange(len(pages)), pc.list_value_length(pages).to_numpy())
        order = np.lexsort((flat.field("node").to_numpy(), row))
        flat, row = flat.take(pa.array(order)), row[order]
        self.node = flat.field("node").to_numpy()
        self.x, self.y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("cx", "cy"))
        self.size = pc.fill_null(pc.list_value_length(flat.field("path")), 0).to_numpy()
        self.steps = flat.field("path").flatten().to_numpy()
        self.first = np.cumsum(self.size) - self.size
        (self.inputs, self.n), (self.labels, self.m) = ((own, np.bincount(row[own], minlength=len(pages))) for own in (np.flatnonzero(flat.field(c).to_numpy(zero_copy_only=False)) for c in ("is_input", "is_label")))
        self.row = row

    def costs(self, a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
        cost = np.minimum(np.hypot(self.x[a] - self.x[b], self.y[a] - self.y[b]), most)
        same, shorter = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        live = np.flatnonzero(shorter > 0)
        while len(live):
            live = live[self.steps[self.first[a[live]] + same[live]] == self.steps[self.first[b[live]] + same[live]]]
            same[live] += 1
            live = live[same[live] < shorter[live]]
        return cost + np.log1p(np.where(same > 0, self.size[a] + self.size[b] - 2 * same, 1_000_000))

    def paired(self, most: float) -> np.ndarray:
        """For each input the label it gets, -1 for none; pages are taken together up to PAIRS pairs, a larger page by itself."""
        out = np.full(len(self.inputs), -1)
        at, begin = np.cumsum(self.n) - self.n, np.cumsum(self.m) - self.m
        page = self.row[self.inputs]
        many = self.m[page]  # labels on the input's page
        full = np.flatnonzero((self.n > 0) & (self.m > 0))
        stops = np.cumsum(self.n[full] * self.m[full])
        i = 0
        while i < len(full):
            z = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + PAIRS, "right")))
            rows = np.arange(at[full[i]], at[full[z - 1]] + self.n[full[z - 1]])
            rows = rows[many[rows] > 0]
            step = max(1, PAIRS // int(many[rows[0]])) if z == i + 1 else len(rows)
            parts = []
            for few in (rows[k : k + step] for k in range(0, len(rows), step)):
                a, size = np.repeat(few, many[few]), many[few]
                b = np.arange(len(a)) + np.repeat(begin[page[few]] - np.cumsum(size) + size, size)
                parts.append(self.costs(self.inputs[a], self.labels[b], most))
            costs, used = np.concatenate(parts), 0
            for k in full[i:z].tolist():
                n, m = int(self.n[k]), int(self.m[k])
                cost = costs[used : used + n * m].reshape(n, m)
                pair = _solved(cost)
                pair[(pair >= 0) & (cost[np.arange(n), np.maximum(pair, 0)] >= 2 * most)] = -1
                out[at[k] : at[k] + n] = np.where(pair >= 0, self.labels[begin[k] + np.maximum(pair, 0)], -1)
                used += n * m
            i = z
        return out


def paired_labels(nodes: DataFrame, page: str, most: float = 500.0) -> DataFrame:
    """page, input and label (null for none): each page's inputs and labels in an assignment of least total cost.

    A pair costs the distance of their centres, ``most`` at most, and the logarithm of their
    distance in the tree; pairs of twice ``most`` or more are let go. ``nodes`` has node, is_input,
    is_label, box and path. A page's inputs and labels are one group.
    """
    kind = dict(nodes.dtypes)[page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Nodes(batch["own"])
            pair = own.paired(most)
            label = pa.array(own.node[np.maximum(pair, 0)], pa.int64(), mask=pair < 0)
            yield pa.RecordBatch.from_arrays([batch[page].take(pa.array(own.row[own.inputs])), pa.array(own.node[own.inputs], pa.int64()), label], names=[page, "input", "label"])

    cx, cy = centre(F.col("box"))
    rows = nodes.where("is_input or is_label").select(page, F.struct(F.col("node").cast("long").alias("node"), "is_input", "is_label", cx.alias("cx"), cy.alias("cy"), "path").alias("n"))
    return rows.groupBy(page).agg(F.collect_list("n").alias("own")).mapInArrow(run, f"`{page}` {kind}, input long, label long")
