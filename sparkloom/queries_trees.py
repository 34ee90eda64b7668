"""Page trees, geometry, traps, fields and cards as registered queries.

Real pages are parsed into nodes; what SQL can check runs on trees that the order tables make:
an order is a page and its root, its lines are nodes below, a returned line has a leaf of its own.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .operators import page_nodes
from .operators import reference_joins as rj
from .operators import trees as K
from .queries_postings import _lit
from .sources import shared

S = SparkSession


def _keep(spark: S):
    """Writes a frame to the shared folder and reads it back."""
    root, number = shared.folder(spark), itertools.count()

    def keep(frame: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{next(number)}-{name}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return keep


@query("k01_page_nodes", "SELECT page_id, len(regexp_extract_all(html, '<(?:a|li|p|h1|article|nav|ul|div)\\b')) AS nodes FROM pages")
def k01(spark: S, d: str) -> DataFrame:
    nodes = page_nodes.parsed(t(spark, d, "pages"), "page_id", "html", ["tag"])
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag").isin("a", "li", "p", "h1", "article", "nav", "ul", "div")).alias("nodes"))


@query("k02_page_hashes")
def k02_pages(spark: S, d: str) -> DataFrame:
    return page_nodes.parsed(t(spark, d, "pages"), "page_id", "html", ["node", "tag", "plain"]).withColumnRenamed("plain", "hash")


@query("f10_k13_k14_k15_c16_page_cards")
def page_cards(spark: S, d: str) -> DataFrame:
    """The cards of the real pages: the best repeated group of each, climbed up, with its texts and link."""
    return page_nodes.page_cards(t(spark, d, "pages"), "page_id", "html", "url", _keep(spark))


def order_nodes(spark: S, d: str) -> DataFrame:
    """page, node, parent, ord, depth, tag, classes of the trees that orders, their lines and returned lines make."""
    lines = t(spark, d, "lineitem").where("l_linenumber is not null").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    page, n = F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int")
    low = lines.select(page, (n * 10).alias("node"), F.lit(0).alias("parent"), n.alias("ord"), F.lit(1).alias("depth"), F.lower("status").alias("tag"), F.concat(F.lit("b "), F.lower("flag")).alias("classes"))
    leaf = lines.where("flag = 'R'").select(page, (n * 10 + 1).alias("node"), (n * 10).alias("parent"), F.lit(0).alias("ord"), F.lit(2).alias("depth"), F.lit("i").alias("tag"), F.lit("z a").alias("classes"))
    root = lines.select(page).distinct().select("page", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.lit("order").alias("tag"), F.lit(None).cast("string").alias("classes"))
    return root.unionByName(low).unionByName(leaf)


_LINES = "ln AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_returnflag) AS flag, lower(min(l_linestatus)) AS tag FROM lineitem GROUP BY 1, 2)"
_HASHES = f"""WITH {_LINES}, h AS (SELECT page, n, md5(tag || ':' || CASE WHEN flag = 'R' THEN '1[' || md5('i:0[]') || ']' ELSE '0[]' END) AS hash, flag = 'R' AS inner_node FROM ln),
   r AS (SELECT page, md5('order:' || count(*) || '[' || string_agg(hash, '' ORDER BY n) || ']') AS hash FROM h GROUP BY 1)"""


@query("k02_structural_hashes", f"{_HASHES} SELECT page, 0 AS node, hash FROM r UNION ALL SELECT page, n * 10, hash FROM h UNION ALL SELECT page, n * 10 + 1, md5('i:0[]') FROM h WHERE inner_node")
def k02(spark: S, d: str) -> DataFrame:
    return K.structural_hashes(order_nodes(spark, d), "page", K.plain_base(), _keep(spark)).select("page", "node", "hash")


@query(
    "k03_classed_hashes",
    f"""WITH {_LINES}, h AS (SELECT page, n, md5(tag || CASE WHEN lower(flag) < 'b' THEN lower(flag) || 'b' ELSE 'b' || lower(flag) END || CASE WHEN flag = 'R' THEN md5('iaz') ELSE '' END) AS hash FROM ln)
       SELECT page, 0 AS node, md5('order' || string_agg(hash, '' ORDER BY n)) AS hash FROM h GROUP BY 1 UNION ALL SELECT page, n * 10, hash FROM h UNION ALL SELECT page, n * 10 + 1, md5('iaz') FROM ln WHERE flag = 'R'""",
)
def k03(spark: S, d: str) -> DataFrame:
    return K.structural_hashes(order_nodes(spark, d), "page", K.classed_base(F.col("classes")), _keep(spark), False).select("page", "node", "hash")


@query("g13_g14_repeated_subtrees", f"{_HASHES}, c AS (SELECT page, hash, count(*) AS times FROM h WHERE inner_node GROUP BY 1, 2 HAVING count(*) >= 2) SELECT page, n * 10 AS node, hash, times FROM h JOIN c USING (page, hash) WHERE inner_node")
def g13(spark: S, d: str) -> DataFrame:
    hashed = K.structural_hashes(order_nodes(spark, d), "page", K.plain_base(), _keep(spark))
    return K.repeated_subtrees(hashed, "page").select("page", "node", "hash", "times")


@query("k04_tree_distance", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 1000000 WHEN s_nationkey = 3 THEN 2 WHEN n_regionkey = 3 THEN 4 ELSE 6 END AS distance FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def k04(spark: S, d: str) -> DataFrame:
    rows = t(spark, d, "supplier").join(rj.small(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    root = F.when(F.col("s_suppkey") % 9 == 0, -1).otherwise(0)
    path = F.array(root, F.col("n_regionkey") + 100, F.col("s_nationkey") + 1000, F.col("s_suppkey") + 100000)
    three = F.array(F.lit(0), F.lit(103), F.lit(1003), F.lit(7))
    return rows.select("s_suppkey", K.tree_distance(path.cast("array<long>"), three.cast("array<long>")).alias("distance"))


def boxes(spark: S, d: str) -> DataFrame:
    """page, node, ord, box, z, path, clickable of the lines of orders, as boxes; every third is a child of its line before."""
    one = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("disc"), F.min("l_tax").alias("tax"))
    n = F.col("l_linenumber").cast("int")
    box = F.struct((F.col("q") * 4).alias("x"), (F.col("disc") * 1000).alias("y"), (F.col("q") * 6 + 20).alias("w"), (F.col("tax") * 2000).alias("h"))
    path = F.when(n % 3 == 0, F.array(F.lit(0), n - 1, n)).otherwise(F.array(F.lit(0), n))
    return one.select(F.col("l_orderkey").alias("page"), n.alias("node"), n.alias("ord"), box.alias("box"), (n % 2).alias("z"), path.alias("path"), (n % 5 != 0).alias("clickable"))


_BOXES = "bx AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_quantity) * 4 AS x, min(l_discount) * 1000 AS y, min(l_quantity) * 6 + 20 AS w, min(l_tax) * 2000 AS h FROM lineitem GROUP BY 1, 2)"


@query("k05_boxes", f"WITH {_BOXES} SELECT page, n AS node, round(sqrt(pow(x + w / 2 - 100, 2) + pow(y + h / 2 - 60, 2)), 4) AS distance, 120 BETWEEN x AND x + w AND 50 BETWEEN y AND y + h AS covers FROM bx")
def k05(spark: S, d: str) -> DataFrame:
    b = F.col("box")
    other = F.struct(F.lit(90.0).alias("x"), F.lit(50.0).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"))
    return boxes(spark, d).select("page", "node", F.round(K.box_distance(b, other), 4).alias("distance"), K.covers(b, F.lit(120.0), F.lit(50.0)).alias("covers"))


@query("k06_hull_extremes", "SELECT p_brand, min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part GROUP BY 1")
def k06(spark: S, d: str) -> DataFrame:
    h = K.hulls(t(spark, d, "part"), "p_brand", "p_size", "p_retailprice")
    xs, ys = F.transform("corners", lambda c: c["x"]), F.transform("corners", lambda c: c["y"])
    return h.select("p_brand", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


@query("k06_hulls")
def k06_hulls(spark: S, d: str) -> DataFrame:
    h = K.hulls(t(spark, d, "part"), "p_brand", "p_size", "p_retailprice")
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1))))
    return h.select("p_brand", F.size("corners").alias("corners"), K.hull_distance(F.col("corners"), square).alias("distance"))


@query("k07_rotated_hit", f"WITH {_BOXES} SELECT page, n AS node, abs(dx) <= w / 2 AND abs(dy) <= h / 2 AS hit FROM (SELECT *, 117.3 - (y + h / 2) AS dy0, 131.7 - (x + w / 2) AS dx0, 117.3 - (y + h / 2) AS dx, -(131.7 - (x + w / 2)) AS dy FROM bx WHERE w > 0 AND h > 0)")
def k07(spark: S, d: str) -> DataFrame:
    b = F.col("box")
    cx, cy = K.centre(b)
    ends = [(b["x"], b["y"]), (b["x"] + b["w"], b["y"]), (b["x"] + b["w"], b["y"] + b["h"]), (b["x"], b["y"] + b["h"])]
    turned = [K.transformed(x, y, (0, 1, -1, 0, 0, 0), cx, cy) for x, y in ends]
    return boxes(spark, d).where("box.w > 0 and box.h > 0").select("page", "node", K.in_polygon(F.lit(131.7), F.lit(117.3), turned).alias("hit"))


@query(
    "k08_occlusion",
    f"""WITH {_BOXES} SELECT a.page, a.n AS node, min(b.n) AS covered_by FROM bx a JOIN bx b ON a.page = b.page AND a.n <> b.n AND b.n % 5 <> 0 AND b.w * b.h > 0 AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h
       WHERE (b.n % 2 > a.n % 2 OR (b.n % 2 = a.n % 2 AND b.n > a.n)) AND NOT (b.n % 3 = 0 AND b.n - 1 = a.n) GROUP BY 1, 2""",
)
def k08(spark: S, d: str) -> DataFrame:
    return K.occluded(boxes(spark, d), "page").select("page", "node", "covered_by")


_NAMES = ["fax_no", "email", "Extra info", "city", "phone"]


@query(
    "k09_traps",
    f"""WITH {_BOXES} SELECT page, n AS node, CASE WHEN w <= 0 OR h <= 0 THEN 'zero size' WHEN w * h < 4 THEN 'too small' WHEN n % 5 IN (0, 2) THEN 'name' WHEN n % 3 = 0 AND EXISTS (SELECT 1 FROM bx u WHERE u.page = b.page AND u.n = b.n - 1 AND (u.w <= 0 OR u.h <= 0)) THEN 'hidden ancestor' WHEN n % 4 = 0 THEN 'no label' END AS reason FROM bx b""",
)
def k09(spark: S, d: str) -> DataFrame:
    rows = boxes(spark, d)
    gone = K.hidden_ancestors(rows, "page").withColumn("gone", F.lit(True))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("node") % 5 + 1)
    reason = K.trap_reason(F.col("box"), name, F.coalesce("gone", F.lit(False)), F.col("node") % 4 != 0)
    return rows.join(gone, ["page", "node"], "left").select("page", "node", reason.alias("reason"))


@query(
    "k17_segmented_traps",
    f"""WITH {_BOXES}, c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM bx) SELECT a.page, a.n AS node, a.w <= 0 OR a.h <= 0 OR a.w * a.h < 1 OR a.n % 5 IN (0, 2) OR (a.n % 4 <> 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.page = a.page AND b.n <> a.n AND b.n % 3 = 0 AND abs(a.cx - b.cx) <= 50 AND abs(a.cy - b.cy) <= 50)) AS trap FROM c a WHERE a.n % 2 = 1""",
)
def k17(spark: S, d: str) -> DataFrame:
    n = F.col("node")
    rows = boxes(spark, d).select("*", (n % 3 == 0).alias("has_text"), (n % 2 == 1).alias("is_input"), (n % 4 == 1).alias("placeholder"), F.element_at(F.array(*map(F.lit, _NAMES)), n % 5 + 1).alias("name"))
    return K.segmented_traps(rows, "page", 50.0)


_FIELDS = ["your email address", "mobile phone", "first name", "city or town", "zip code", "upload resume", "portfolio website", "state", "something", "cover letter"]


def _score(kind: str) -> str:
    hit = lambda c: "(" + " OR ".join(f"contains({c}, {_lit(w)})" for w in K.FIELD_WORDS[kind]) + ")"
    return f"CASE WHEN {hit('label')} THEN 10 ELSE 0 END + CASE WHEN {hit('name')} THEN 12 ELSE 0 END"


_TYPES = list(K.FIELD_WORDS)


@query(
    "k10_field_types",
    f"""SELECT p_partkey, CASE WHEN list_max(s) > 0 THEN [{', '.join(map(_lit, _TYPES))}][list_position(s, list_max(s))] ELSE 'text' END AS kind FROM (SELECT p_partkey, [{', '.join(_score(k) for k in _TYPES)}] AS s FROM
       (SELECT p_partkey, [{', '.join(map(_lit, _FIELDS))}][p_partkey % 10 + 1] AS label, [{', '.join(map(_lit, _FIELDS))}][p_size % 10 + 1] AS name FROM part))""",
)
def k10(spark: S, d: str) -> DataFrame:
    pick = lambda c: F.element_at(F.array(*map(F.lit, _FIELDS)), (F.col(c) % 10 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", K.best_type(K.field_scores({"label": pick("p_partkey"), "name": pick("p_size")})).alias("kind"))


@query(
    "k16_segmented_types",
    f"""SELECT p_partkey, CASE WHEN contains(x, 'first') AND contains(x, 'name') THEN 'first_name' WHEN p_size % 3 = 0 AND (contains(x, 'resume')) THEN 'resume_upload' WHEN p_size % 3 = 0 AND contains(x, 'cover') THEN 'cover_letter_upload'
       WHEN contains(x, 'email') THEN 'email' WHEN contains(x, 'phone') THEN 'telephone' WHEN contains(x, 'city') THEN 'city' WHEN contains(x, 'state') THEN 'state' WHEN contains(x, 'zip') THEN 'zip_code' WHEN contains(x, 'portfolio') THEN 'portfolio_url'
       WHEN p_size % 5 = 0 THEN 'select' WHEN p_size % 3 = 0 THEN 'resume_upload' ELSE 'text' END AS kind FROM (SELECT *, [{', '.join(map(_lit, _FIELDS))}][p_partkey % 10 + 1] AS x FROM part)""",
)
def k16(spark: S, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _FIELDS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    kind = F.when(F.col("p_size") % 3 == 0, "file").otherwise("text")
    return t(spark, d, "part").select("p_partkey", K.segmented_type(kind, text, F.lit("x"), F.col("p_size") % 5 == 0).alias("kind"))


@query(
    "k12_form_containers",
    "WITH ln AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem), g AS (SELECT page, n % 2 AS half, count(*) AS inputs FROM ln GROUP BY 1, 2), a AS (SELECT page, half + 1 AS node, inputs FROM g WHERE inputs >= 2) SELECT * FROM a UNION ALL SELECT page, 0, sum(inputs) FROM g WHERE page NOT IN (SELECT page FROM a) GROUP BY 1 HAVING sum(inputs) >= 2",
)
def k12(spark: S, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("n")).distinct()
    half = F.col("n") % 2 + 1
    node = lines.select("page", (F.col("n") + 10).alias("node"), F.array(F.lit(0), half, F.col("n") + 10).alias("path"), F.lit(True).alias("is_input"))
    above = lines.select("page", half.alias("node"), F.array(F.lit(0), half).alias("path"), F.lit(False).alias("is_input")).distinct()
    root = lines.select("page", F.lit(0).alias("node"), F.array(F.lit(0)).alias("path"), F.lit(False).alias("is_input")).distinct()
    return K.form_containers(node.unionByName(above).unionByName(root), "page").select("page", "node", "inputs")


@query(
    "k13_identity_attributes",
    """WITH e AS (SELECT l_partkey AS page, l_orderkey * 10 + l_linenumber AS node, 'data-job' AS name, CAST(l_orderkey AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, 'class', l_returnflag FROM lineitem UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, 'data-index', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) FROM lineitem),
       t AS (SELECT page, count(DISTINCT node) AS cards FROM e GROUP BY 1), u AS (SELECT page, name, value, count(*) AS uses FROM e GROUP BY 1, 2, 3), p AS (SELECT page, name, sum(uses) AS present, count(*) AS kinds, count(*) FILTER (WHERE uses = 1) AS uniq FROM u GROUP BY 1, 2)
       SELECT page, name FROM p JOIN t USING (page) WHERE name <> 'data-index' AND present >= greatest(2, floor(0.6 * cards)) AND kinds > 1 AND kinds >= greatest(2, floor(0.6 * present)) AND uniq / present >= 0.8""",
)
def k13(spark: S, d: str) -> DataFrame:
    l = t(spark, d, "lineitem")  # noqa: E741
    node = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    names = {"data-job": F.col("l_orderkey").cast("string"), "class": F.col("l_returnflag"), "data-index": node.cast("string")}
    rows = l.select(F.col("l_partkey").alias("page"), node.alias("node"), F.explode(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), v)))).alias("name", "value"))
    return K.identity_attributes(rows, "page", rows)


@query("k14_card_levels", "WITH c AS (SELECT s_nationkey % 5 AS page, count(*) AS n, count(DISTINCT s_nationkey) AS k FROM supplier GROUP BY 1) SELECT page, CASE WHEN k < n THEN 0 WHEN n > 1 THEN 1 ELSE 12 END AS levels FROM c")
def k14(spark: S, d: str) -> DataFrame:
    path = F.array(F.lit(0).cast("long"), F.col("s_nationkey").cast("long") + 10, F.col("s_suppkey").cast("long") + 1000)
    return K.card_levels(t(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("page"), path.alias("path")), "page")


@query(
    "k15_card_texts",
    """WITH n AS (SELECT DISTINCT l_orderkey AS card, l_linenumber AS ord, CASE WHEN l_linenumber % 3 = 0 THEN 'h2' ELSE 'p' END AS tag, 'text ' || l_linenumber AS text, (l_linenumber * 7 % 4)::DOUBLE AS height FROM lineitem), t AS (SELECT card, arg_max(text, (height + length(text) / 10, -ord)) AS title FROM n WHERE tag = 'h2' GROUP BY 1),
       r AS (SELECT n.card, n.text, row_number() OVER (PARTITION BY n.card ORDER BY n.ord) AS i FROM n LEFT JOIN t ON n.card = t.card WHERE title IS NULL OR text <> title) SELECT c.card, coalesce(title, '') AS title, coalesce(a.text, '') AS company, coalesce(b.text, '') AS location FROM (SELECT DISTINCT card FROM n) c LEFT JOIN t ON c.card = t.card LEFT JOIN r a ON c.card = a.card AND a.i = 1 LEFT JOIN r b ON c.card = b.card AND b.i = 2""",
)
def k15(spark: S, d: str) -> DataFrame:
    n = F.col("l_linenumber").cast("int")
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), n.alias("ord"), F.when(n % 3 == 0, "h2").otherwise("p").alias("tag"), F.lit(None).cast("string").alias("role"), F.concat(F.lit("text "), n.cast("string")).alias("text"), (n * 7 % 4).cast("double").alias("height")).distinct()
    return K.card_texts(rows, "card")


@query("c15_k11_label_pairs")
def c15(spark: S, d: str) -> DataFrame:
    n = F.col("node")
    rows = boxes(spark, d).select("*", (n % 2 == 1).alias("is_input"), (n % 2 == 0).alias("is_label"))
    return K.paired_labels(rows, "page")
