"""Terms of a table in texts against brute force, in one slice and in many."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lexicon, reference_joins


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_hits_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lexicon, "SLICE", size)
    rng = random.Random(size)
    word = lambda n: "".join(rng.choice("abé🙂 ") for _ in range(rng.randrange(n)))
    texts = [(i, word(60)) for i in range(60)] + [(7, "abab"), (None, "ab"), (100, None)]
    terms = [(i, word(5)) for i in range(40)] + [(98, "ab"), (99, "ab"), (None, "a"), (5, None)]
    got = lexicon.hits(spark.createDataFrame(texts, "term_id long, start string").repartition(3), "term_id", "start", spark.createDataFrame(terms, "id int, term string"), "term", "id").collect()
    ids = sorted({(i, t) for i, t in terms if i is not None and t}, key=repr)
    want = [(k, i, a, a + len(term)) for k, t in texts for i, term in ids for a in range(len(t or "")) if (t or "").startswith(term, a)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert lexicon.hits(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([], "term_id int, term string")).count() == 0


def test_cost_does_not_follow_the_number_of_terms():
    many = lexicon.automaton("many", [(f"term{i}x", [i]) for i in range(100_000)])
    assert [v for _, (_, ids) in many.iter("a term99999x and term5xterm6x") for v in ids] == [99999, 5, 6]


def test_either_name_holds_the_other(spark):
    a = [(i, n) for i, n in enumerate(["abc", "b", "xabcx", "", None, "zz", "b"])]
    b = [(i, n) for i, n in enumerate(["abc", "bc", "", None, "a", "zzz"])]
    got = lexicon.mutual_substring(spark.createDataFrame(a, "i int, n string"), "n", spark.createDataFrame(b, "j int, m string"), "m").collect()
    want = {(i, n, j, m) for i, n in a for j, m in b if n is not None and m is not None and (n in m or m in n)}
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_globs_are_tried_by_their_literals(spark):
    urls = [(1, "https://jobs.Example.com/a"), (2, "x.example.org/en/1"), (3, "other"), (4, None), (5, "")]
    globs = [("*.example.com/*", "com", 1), ("*.example.org/e?/*", "never", 0), ("*EXAMPLE*", "any", 3), ("*", "rest", 9), ("**", "rest", 10)]
    df, g = spark.createDataFrame(urls, "k int, u string"), spark.createDataFrame(globs, "glob string, platform string, load_order int")
    assert {r["k"]: r["platform"] for r in reference_joins.platform_by_pattern(df, "u", "k", g).collect()} == {1: "com", 2: "any", 3: "rest", 5: "rest"}
    assert [r[0] for r in g.orderBy("load_order").select(lexicon.longest_literal(F.col("glob"))).collect()] == [".example.org/e?/", ".example.com/", "example", "", ""]


def test_weights_add_up_once_a_term(spark):
    df = spark.createDataFrame([(1, "Ab ab cd"), (2, "x"), (3, None)], "k int, t string")
    lex = spark.createDataFrame([("ab", 0.5), ("AB", 0.25), ("cd", 1.0)], "term string, weight double")
    assert [tuple(r) for r in lexicon.weighed(df, "k", "t", lex).collect()] == [(1, 1.5, 2)]
