"""Queries over long texts and many rows: what a task shuffles and how often it reads a text."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import identity, text
from sparkloom.operators import detectors, lexicon, trees
from sparkloom.sources import warc


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ordered_distinct_words_shuffle_nothing(spark):
    words = [["b", "A", "B", "a", None, "c", None], [], None, ["Ä", "ä", "x"], ["x"]]
    frame = spark.createDataFrame([*enumerate(words), (None, ["x"]), *((k, [str(k), "W", "w"]) for k in range(100, 1900))], "k long, w array<string>")
    got = identity.ordered_distinct(frame.repartition(2), "k", F.col("w"))
    assert "Exchange hashpartitioning" not in plan_of(got)
    found = {r["k"]: r["words"] for r in got.collect()}
    assert found == {0: ["b", "A", None, "c"], 1: [], 3: ["Ä", "x"], 4: ["x"], None: [], **{k: [str(k), "W"] for k in range(100, 1900)}}


def detected(spark, texts, found):
    frame = spark.createDataFrame([(k, "Junior Software Engineer", x) for k, x in enumerate(texts)], "k long, title string, text string")
    return detectors.run(frame, "k", [found], False)


def test_title_mismatch_reads_a_text_once_and_its_first_150_words_only(spark):
    far = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150))
    texts = [far + " software engineer", far, " \t" + far, far[: far.rindex(" ")] + " software", "software engineer", "", None, far + " ", far + "\n" + far]
    got = detected(spark, texts, detectors.title_mismatch(F.col("title"), F.col("text")))
    assert plan_of(got).count("regexp_extract_all") == 2
    assert {r["k"]: round(r["confidence"], 6) for r in got.collect()} == dict.fromkeys((0, 1, 2, 7, 8), 0.8)


def test_hard_reading_counts_syllables_outside_of_lambdas(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "the", "queue", "Readability", "extraordinarily", "x9", "étude", "internationalisation", "--", "e"])
    texts = [rng.choice(["", " ", "\n", "  a"]) + rng.choice([" ", "\t", " \n"]).join(word() + rng.choice(["", "", "", ".", "! "]) for _ in range(n)) + rng.choice(["", " "]) for n in (0, 1, 48, 49, 50, 51, 300) for _ in range(30)]
    texts += [None, " ".join(["extraordinarily"] * 49), " ".join(["extraordinarily"] * 50), " ".join(["extraordinarily"] * 60)]
    got = detected(spark, texts, detectors.hard_reading(F.col("title"), F.col("text")))
    assert "aggregate(" not in plan_of(got)
    plain = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select(
        "k", F.size(F.filter(F.split("text", "\\s+"), lambda w: F.length(w) > 0)).alias("n"), text.flesch_kincaid(F.col("text")).alias("grade"))
    want = {r["k"]: min(0.78, 0.45 + (r["grade"] - 16) * 0.05) for r in plain.where("n >= 50 and grade >= 16").collect()}
    assert {r["k"]: r["confidence"] for r in got.collect()} == want
    assert 212 in want and 211 not in want and len(want) > 50


def test_coded_words_reads_a_text_once(spark):
    texts = ["Leader, LEADER leader", "leader loyal warm", "leader team-player decision-maker warm caring", "driven_leader leader2", "", None, "elite_ elite elite elite " + "x " * 5000]
    got = detected(spark, texts, detectors.coded_words(F.col("text")))
    assert plan_of(got).count("regexp_extract_all") == 1
    assert {r["k"]: (r["severity"], round(r["confidence"], 6)) for r in got.collect()} == {0: ("violation", 0.9), 6: ("violation", 0.9), 1: ("flag", 0.766667), 2: ("flag", 0.766667)}


def test_archive_members_are_packed_a_few_pages_at_a_time(spark):
    page = bytes(range(256)) * 40
    copies = spark.range(700).selectExpr("'u' || id uri", "'2024-01-0' || (1 + id % 9) day").withColumn("payload", F.lit(page))
    packed = warc.archived(copies.coalesce(1))
    assert "InPandas" not in plan_of(packed)
    assert [b.num_rows for b in warc.sliced(iter([pa.record_batch({"x": range(130)})]))] == [64, 64, 2]
    got = warc.members(packed.select(F.col("copy_id").alias("path"), "content"))
    assert "InPandas" not in plan_of(got)
    assert got.where(F.col("error").isNull() & (F.col("payload") == F.lit(page)) & (F.col("kind") == "resource")).select("uri").distinct().count() == got.count() == 700


def test_places_of_a_text_that_is_full_of_terms_are_sent_on_in_between():
    own = lexicon.automaton("test", [("ab", [1, 2]), ("b", [3])])
    batch = pa.record_batch({"k": [7, 8, 9], "t": ["ab" * 30_000, None, "xb"]})
    got = list(lexicon.places(own, iter([batch]), "term", pa.int64()))
    assert max(x.num_rows for x in got) <= lexicon.BATCH and len(got) == 5
    found = pa.Table.from_batches(got)
    assert found.num_rows == 90_001 and found.slice(90_000).to_pylist() == [{"k": 9, "term": 3, "start": 1, "stop": 2}]


def test_labels_are_paired_as_page_by_page(spark):
    """Costs of many pages at once and assignments in lists give what a matrix a page gives, for any mix of pages."""
    rng = random.Random(5)
    nodes = []
    for page in range(300):
        for node in rng.sample(range(50), rng.choice([0, 1, 2, 5, 9, 40])):
            kind = rng.random()
            nodes.append((f"p{page}", node, kind < 0.5, 0.4 < kind < 0.9, (rng.choice([0.0, 30.0, 700.0]), rng.uniform(0, 90), 0.0, 0.0), [rng.randint(0, 1) for _ in range(rng.randint(0, 4))]))
    frame = spark.createDataFrame(nodes, "page string, node int, is_input boolean, is_label boolean, box struct<x: double, y: double, w: double, h: double>, path array<int>")
    want = set()
    for page in {n[0] for n in nodes}:
        a, b = (sorted((n for n in nodes if n[0] == page and n[side]), key=lambda n: n[1]) for side in (2, 3))
        cost = np.zeros((len(a), len(b)))
        for i, j in np.ndindex(*cost.shape):
            (x, y, w, h), (u, v, *_), p, q = a[i][4], b[j][4], a[i][5], b[j][5]
            same = next((k for k, (s, t) in enumerate(zip(p, q, strict=False)) if s != t), min(len(p), len(q)))
            cost[i, j] = min(np.hypot(x - u, y - v), 500.0) + np.log1p(len(p) + len(q) - 2 * same if same else 1_000_000)
        pair = trees.assignment(cost) if a and b else np.full(len(a), -1)
        want |= {(page, n[1], b[j][1] if j >= 0 and cost[i, j] < 1000 else None) for i, (n, j) in enumerate(zip(a, pair.tolist(), strict=True))}
    got = trees.paired_labels(frame, "page")
    assert "InPandas" not in plan_of(got)
    assert {tuple(r) for r in got.collect()} == want
