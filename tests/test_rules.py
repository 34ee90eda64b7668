"""Rules of the operators that read text, trees, places and identities, on small literal inputs."""

import base64
import datetime
import itertools
import math
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import identity, stats, text, urls
from sparkloom.operators import detectors, reference_joins, sequences, trees, url_evidence, vetting
from sparkloom.sources import export, warc
from sparkloom.streaming import ingest


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_coded_words_ties_stay_below_the_threshold(spark):
    four = "competitive assertive confident leader support", "violation", "concern"
    seven = "competitive assertive confident leader driven elite champion support loyal warm", "concern", "flag"  # 0.4
    for words, _, want in (four, seven):
        got = detectors.run(rows(spark, [(1, words)], "id long, text string"), "id", [detectors.coded_words(F.col("text"))], False).first()
        assert got["severity"] == want


def test_thresholds_of_detectors_at_ties(spark):
    one = rows(spark, [(1,)], "id long")
    severity = lambda c: one.select(c["severity"].alias("s")).first()["s"]
    assert severity(detectors.platform_spread(F.lit(2), F.lit(60))) == "concern" and severity(detectors.platform_spread(F.lit(2), F.lit(61))) == "violation"
    assert severity(detectors.wide_range(F.lit(10), F.lit(30))) == "violation" and severity(detectors.wide_range(F.lit(10), F.lit(20))) == "concern"
    assert severity(detectors.pay_against_skills(F.lit("kubernetes terraform machine learning system design"), F.lit(65_000))) is None
    assert severity(detectors.phantom_company(F.lit(29), F.lit(89), F.lit(None).cast("boolean"))) == "concern"
    assert severity(detectors.phantom_company(F.lit(30), F.lit(89), F.lit(True))) is None
    assert severity(detectors.low_for_place(F.lit(None), F.lit(44_200), F.lit(1.0))) is None and severity(detectors.low_for_place(F.lit(None), F.lit(44_199), F.lit(1.0))) == "flag"


def test_moving_average_in_blocks_equals_one_by_one(spark):
    rng = random.Random(1)
    data = [(k, i * 997, rng.random()) for k in (1, 2) for i in range(300)]
    got = {r["k"]: (r["ema"], r["n"]) for r in sequences.ema(rows(spark, data, "k long, i long, v double"), "k", ["i"], "v", 0.3).collect()}
    for k in (1, 2):
        want = None
        for _, _, v in sorted(x for x in data if x[0] == k):
            want = v if want is None else want * 0.7 + v * 0.3
        assert got[k] == (pytest.approx(want), 300)


def test_budget_keeps_the_newest_that_fit(spark):
    data = [("a", i, 10) for i in range(5000)] + [("b", 7, 99), ("b", 6, 1)]
    got = {tuple(r) for r in sequences.within_budget(rows(spark, data, "p string, i long, n long"), "p", "i", "n", 95).select("p", "i").collect()}
    assert got == {("a", i) for i in range(4991, 5000)} | {("b", 7)}


def test_stream_of_many_shuffled_files_loses_nothing(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    data = [(k, day + datetime.timedelta(days=d, minutes=m)) for k in range(3) for d in range(0, 60, 3) for m in (0, 5)]
    random.Random(2).shuffle(data)
    frame = rows(spark, data, "k long, ts timestamp")
    frame.repartition(24).write.parquet(str(tmp_path / "in"))
    ingest.ingest_sightings(ingest.read_folder(spark, str(tmp_path / "in"), frame.schema, 2), ["k"], "ts", str(tmp_path / "days"), str(tmp_path / "state"))
    assert {(r["k"], r["times_seen"]) for r in ingest.lifecycles_of(spark, str(tmp_path / "days"), ["k"]).collect()} == {(k, 20) for k in range(3)}


def test_identities(spark):
    assert identity.canonical_name("  ＡＣＭＥ​  Corp ") == "acme corp" == identity.canonical_name(identity.canonical_name("Acme CORP"))
    frame = rows(spark, [("Acme",), ("ACME ",), ("Unknown",), ("",), (None,), ("Acme Corp",)], "n string")
    got = [r["i"] for r in frame.select(identity.company_id(F.col("n"), "s").alias("i")).collect()]
    assert got[0] == got[1] != got[5] and got[2:5] == [None] * 3 and len(got[0]) == 16
    kinds = {x: frame.limit(1).select(identity.locale(F.lit(x)).alias("l")).first()["l"] for x in ("en_GB.UTF-8", "es", "C", "English_United States", "eng", " ")}
    assert [tuple(kinds[x]) if kinds[x] else None for x in kinds] == [("en", "GB"), ("es", None), None, ("en", "US"), None, None]
    line = frame.limit(1).select(identity.content_hash({"b": F.lit("é"), "a": F.lit(None).cast("string")}).alias("h")).first()["h"]
    import hashlib

    assert line == hashlib.sha256(b'{"a": "", "b": "\\u00e9"}').hexdigest()


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        for _ in range(10):
            cost = rng.integers(0, 20, (n, m)).astype(float)
            got = trees.assignment(cost)
            k = min(n, m)
            best = min(sum(cost[r, c] for r, c in zip(rs, cs, strict=True)) for rs in itertools.permutations(range(n), k) for cs in itertools.combinations(range(m), k))
            assert sum(got >= 0) == k and len(set(got[got >= 0])) == k
            assert sum(cost[r, c] for r, c in enumerate(got) if c >= 0) == best


def test_labels_of_inputs(spark):
    box = lambda x, y: {"x": float(x), "y": float(y), "w": 2.0, "h": 2.0}
    nodes = [(1, 1, True, False, box(0, 0), [0, 1]), (1, 2, True, False, box(100, 0), [0, 2]), (1, 3, False, True, box(90, 0), [0, 3]), (1, 4, False, True, box(5, 0), [0, 4]), (2, 1, True, False, box(0, 0), [0, 1])]
    frame = rows(spark, nodes, "page long, node int, is_input boolean, is_label boolean, box struct<x:double,y:double,w:double,h:double>, path array<int>")
    assert {tuple(r) for r in trees.paired_labels(frame, "page").collect()} == {(1, 1, 4), (1, 2, 3), (2, 1, None)}


def test_hulls(spark):
    rng = random.Random(3)
    points = [("g", rng.gauss(0, 10), rng.gauss(0, 3)) for _ in range(400)] + [("two", 0.0, 0.0), ("two", 1.0, 1.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0)]
    got = {r["g"]: [(c["x"], c["y"]) for c in r["corners"]] for r in trees.hulls(rows(spark, points, "g string, x double, y double"), "g", "x", "y").collect()}
    assert sorted(got["two"]) == [(0, 0), (1, 1)] and sorted(got["line"]) == [(0, 0), (2, 2)]
    corners = got["g"]
    for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
        assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for g, x, y in points if g == "g")


def test_card_levels_and_distances(spark):
    cards = rows(spark, [(1, [0, 1, 2]), (1, [0, 3, 4]), (2, [0, 1, 2])], "page long, path array<int>")
    assert {tuple(r) for r in trees.card_levels(cards, "page").collect()} == {(1, 1), (2, 12)}
    d = cards.limit(1).select(trees.tree_distance(F.lit([0, 1, 2]), F.lit([0, 3])).alias("a"), trees.tree_distance(F.lit([5, 1]), F.lit([0, 1])).alias("b")).first()
    assert (d["a"], d["b"]) == (3, 1_000_000)


def test_links(spark):
    page = "https://board.example.org/list/page"
    data = [(1, "/a?u=https%3A%2F%2Fx.org%2Fy", "Apply"), (1, "https://ads.x.org/", "a"), (1, "#x", "a"), (1, "javascript:x", "a"), (1, "https://z.org/privacy", "Privacy"), (2, "https://adobe.com/admin", "see"), (3, "  ", "blank")]
    out = url_evidence.evaluated(rows(spark, [(*x, "the engineer", page) for x in data], "card long, href string, text string, title string, page string"), "href", "text", "title", "page")
    got = [(r["url"], r["rejected"]) for r in out.collect()]
    assert got[0] == ("https://x.org/y", None) and [g[1] for g in got[1:]] == ["advertising evidence", "fragment-only URL", "denied scheme", "dead-end text", None]
    assert {(r["card"], r["state"]) for r in url_evidence.resolutions(out, "card").collect()} == {(1, "resolved"), (2, "resolved")}
    one = rows(spark, [("see http://A.org/x?y or www.b.org/c and q.org › jobs › 1",)], "t string")
    assert one.select(urls.redacted(F.col("t")).alias("t")).first()["t"] == "see a.org or www.b.org and q.org"


def test_similarity_and_best_match(spark):
    frame = rows(spark, [(1, "Data analyst II"), (2, "zzz"), (3, None)], "id long, t string")
    got = {r["id"]: (r["match"], round(r["score"], 3)) for r in text.best_match(frame, "id", "t", ["data engineer", "data analyst", "nurse"]).collect()}
    assert got[1][0] == "data analyst" and got[2] == ("data engineer", 0.0) and got[3] == ("data engineer", 0.0)


def test_word_syllables_of_texts_laid_end_to_end():
    texts = [b"table queue e", b"", b"idea", b"Reading123apple", b"x"]
    syl, first = text.word_syllables(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert syl.tolist() == [1, 1, 1, 2, 2, 1, 1] and first.tolist() == [0, 3, 3, 4, 6, 7]


def test_reference_tables_that_are_too_large_are_refused(spark):
    with pytest.raises(ValueError, match="more than 5"):
        reference_joins.small(spark.range(6), 5, True)
    reference_joins.small(spark.range(6), 5).count()


def test_throttle_order(spark):
    history = rows(spark, [("a", datetime.date(2024, 1, 1)), ("b", datetime.date(2024, 1, 9)), ("b", datetime.date(2024, 1, 9))], "c string, day date")
    jobs = rows(spark, [("a",), ("b",), ("new",), (None,)], "c string")
    mandates = rows(spark, [("a", 30)], "c string, days int")
    run = lambda daily, cap: {r["c"]: r["reason"] for r in vetting.throttled(jobs, history, mandates, "c", "day", "2024-01-09", daily, cap, None, 0).collect()}
    assert run(9, 2) == {"a": "cooldown", "b": "company cap", "new": None, None: None}
    assert set(run(2, 2).values()) == {"daily limit"}


def test_archive_keeps_copies_once_and_reads_back(spark, tmp_path):
    copies = rows(spark, [("u", "2024-01-02", b"x"), ("u", "2024-01-01", b"x"), ("v", "2024-01-03", b"y")], "uri string, day string, payload binary")
    warc.store(copies, str(tmp_path / "w"), 1 << 30)
    kept = spark.read.parquet(str(tmp_path / "w"))
    got = warc.members(kept.select(F.col("copy_id").alias("path"), "content"))
    assert {(r["uri"], r["day"], bytes(r["payload"])) for r in got.collect()} == {("u", "2024-01-01", b"x"), ("v", "2024-01-03", b"y")}


def test_bundle_names_what_was_asked_for(spark, tmp_path):
    tables = {"t": (spark.range(10), ["id"])}
    _, csv = export.bundle(spark, tables, str(tmp_path / "a"), "csv")
    _, again = export.bundle(spark, tables, str(tmp_path / "b"), "csv")
    _, other = export.bundle(spark, tables, str(tmp_path / "c"), "feather")
    assert csv == again != other


def test_bundle_is_the_same_for_rows_in_other_partitions_and_with_equal_keys(spark, tmp_path):
    wide = spark.range(60_000).selectExpr("if(id % 50 = 0, null, id div 2) k", "id % 7 v", "repeat(cast(id as string), 20) s")
    (a, one), (b, two) = (export.bundle(spark, {"t": (x, ["k"])}, str(tmp_path / n), "csv") for n, x in (("a", wide), ("b", wide.repartition(7))))
    assert one == two and a.collect() == b.collect()
    export.write_files(wide, ["k"], str(tmp_path / "c"), "json", 25_000)
    got = sorted(tuple(r) for r in spark.read.json(str(tmp_path / "c")).groupBy(F.col("_metadata.file_name")).agg(F.count("*"), F.coalesce(F.min("k"), F.lit(-1)), F.max("k")).collect())
    assert [r[1] for r in got] == [25_000, 25_000, 10_000] and got[0][3] <= got[1][2] <= got[1][3] <= got[2][2]


def test_boxes_without_a_top_come_last(spark):
    boxes = spark.createDataFrame([(1, 0.0, 3.0), (1, 20.0, 23.0), (1, None, None)], "p int, top double, bottom double")
    got = {r["top"]: r["cluster"] for r in sequences.gap_clusters(boxes, "p", "top", "bottom", 5).collect()}
    assert got == {0.0: 0, 20.0: 1, None: 1}


def test_base64_payload_in_lines_is_unwrapped(spark):
    url = "https://careers.example.org/a/long/path/of/words/that/goes/on?for=a&while=longer"
    lines = base64.encodebytes(url.encode()).decode().replace("\n", "\r\n")
    wrapped = [f"https://r.example.net/go?q={urllib.parse.quote(p + lines.strip(), safe='')}" for p in ("", "a", "a1")]
    got = spark.createDataFrame([(w,) for w in wrapped], "u string").select(url_evidence.unwrapped(F.col("u")).alias("x"))
    assert lines.count("\r\n") == 2 and [r["x"] for r in got.collect()] == [url] * 3


def test_currency_without_places_cuts_the_fraction_and_keeps_the_sign(spark):
    got = spark.createDataFrame([(-0.4,), (-1234.9,), (0.9,), (1e6,), (None,)], "x double").select(identity.currency(F.col("x"), "$", 0).alias("v")).collect()
    assert [r["v"] for r in got] == ["-$0", "-$1,234", "$0", "$1,000,000", None]


def test_exact_test_of_large_tables_costs_a_fixed_amount_a_cell(spark):
    numbers = [0, 1, 2, 9, 15, 16, 17, 40, 1_000, 10**6, 3 * 10**9]
    got = {r["n"]: r["v"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", stats.ln_factorial(F.col("n")).alias("v")).collect()}
    assert [got[n] for n in numbers] == pytest.approx([math.lgamma(n + 1) for n in numbers], rel=1e-14, abs=1e-13)
    a, b, c, d = 60_300, 59_700, 60_000, 60_000
    k = np.arange(a + c - min(a + c, c + d), min(a + b, a + c) + 1)
    f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, a + b + c + d + 1)))])
    p = np.exp(f[a + b] + f[c + d] + f[a + c] + f[b + d] - f[-1] - f[k] - f[a + b - k] - f[a + c - k] - f[c + d - a - c + k])
    want = p[p <= p[k == a] * (1 + 1e-7)].sum()
    got = stats.fisher_exact(spark.createDataFrame([("t", a, b, c, d)], "key string, a long, b long, c long, d long")).first()["p_value"]
    assert got == pytest.approx(want, rel=1e-6)


def test_point_in_polygon_by_array_and_by_columns(spark):
    rng = random.Random(3)
    rows = [tuple(float(rng.randrange(8)) for _ in range(12)) for _ in range(300)]
    names = [f"c{i}" for i in range(12)]
    pairs = [(F.col(names[i]), F.col(names[i + 1])) for i in range(2, 12, 2)]
    array = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in pairs))
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(trees.in_polygon(F.col("c0"), F.col("c1"), pairs).alias("a"), trees.in_polygon(F.col("c0"), F.col("c1"), array).alias("b")).collect()

    def inside(x, y, *c):
        odd = False
        for (px, py), (qx, qy) in zip(p := list(zip(c[::2], c[1::2])), p[1:] + p[:1]):
            if min(py, qy) < y <= max(py, qy) and x <= max(px, qx):
                odd ^= px == qx or x <= (y - py) * (qx - px) / (qy - py) + px
        return odd

    assert [(r["a"], r["b"]) for r in got] == [(inside(*r),) * 2 for r in rows]
