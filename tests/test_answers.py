"""Answers of mixed type on small inputs, ties and nulls included."""

import json
import statistics

import pytest

from sparkloom.operators import answers

ROWS = [
    ("a", '["x","y","x"]'), ("a", '"x"'), ("a", "3"), ("a", "4.5"), ("a", "10"), ("a", "true"), ("a", "false"), ("a", "true"), ("a", "null"), ("a", None), ("a", "{"), ("a", '{"k": 1}'), ("a", "[]"), ("a", '[1, null, "z"]'), ("b", "7"), (None, '"x"'), (None, "-2e3"),
]


def test_tallies_and_medians(spark):
    df = spark.createDataFrame(ROWS, "q string, answer string")
    got = {(r["q"], r["choice"]): (r["n"], r["share"]) for r in answers.tallies(df, "q", "answer").collect()}
    assert got == {("a", "x"): (2, 2 / 11), ("a", "y"): (1, 1 / 11), ("a", "1"): (1, 1 / 11), ("a", "z"): (1, 1 / 11), (None, "x"): (1, 1 / 2)}
    rows = {r["q"]: r for r in answers.insights(df, "q", "answer").collect()}
    a = rows["a"]
    assert (a["n"], a["n_lists"], a["n_texts"], a["n_numbers"], a["n_truths"], a["n_none"], a["n_invalid"]) == (14, 3, 1, 3, 3, 2, 1)
    assert a["median"] == statistics.median([3, 4.5, 10]) and a["rate"] == pytest.approx(2 / 3) and 0 < a["low"] < a["rate"] < a["high"] < 1
    assert rows["b"]["median"] == 7 and rows["b"]["rate"] is None and rows[None]["median"] == -2000
    assert answers.tallies(df.where("false"), "q", "answer").count() == answers.insights(df.where("false"), "q", "answer").count() == 0


def test_problems_of_answers(spark):
    rules = spark.createDataFrame([("n", "number", True, None, 1.0, 5.0), ("m", "list", False, ["x", "y"], None, None), ("t", "truth", True, None, None, None)], "q string, kind string, required boolean, choices array<string>, low double, high double")
    cases = [("n", "3", []), ("n", "0", ["too low"]), ("n", "9", ["too high"]), ("n", "null", ["missing"]), ("n", '"3"', ["wrong kind"]), ("n", "{", ["invalid"]), ("m", '["x","w"]', ["unknown choice"]), ("m", '["x"]', []), ("m", None, []), ("t", "true", []), ("t", None, ["missing"]), ("z", "1", ["unknown question"]), (None, "[", ["unknown question", "invalid"])]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(cases)], "i int, q string, answer string")
    got = {r["i"]: r["problems"] for r in answers.validated(df, "q", "answer", rules).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    assert json.loads("[]") == []
