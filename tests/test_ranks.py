"""Exact percentiles, percentiles of the past, and rank correlation against plain versions, in many small ranges."""

import math
import random

import numpy as np
import pytest

from sparkloom.operators import prefix_orders, rank_correlation, selection


def plain(values, p):
    v = sorted(values)
    r = p * (len(v) - 1)
    lo, hi = v[math.floor(r)], v[math.ceil(r)]
    return lo + (hi - lo) * (r - math.floor(r))


def data(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "b", "c", None])
        value = rng.choice([None, 5.0, 5.0, rng.gauss(0, 10), rng.lognormvariate(0, 3), -7.5])
        rows.append((i, key, value))
    return rows + [(n, "one", 3.0), (n + 1, "none", None)]


@pytest.mark.parametrize("most", [0, 150, 10**6])
def test_percentiles_of_small_and_large_keys(spark, most):
    rows = data()
    df = spark.createDataFrame(rows, "i int, k string, v double").repartition(3)
    got = {(r["k"], r["p"]): (r["percentile"], r["n"]) for r in selection.percentiles(df, ["k"], "v", [0.25, 0.5, 0.99], most=most, parts=9).collect()}
    keys = {k for _, k, v in rows if v is not None}
    assert set(got) == {(k, p) for k in keys for p in (0.25, 0.5, 0.99)}
    for (k, p), (x, n) in got.items():
        own = [v for _, key, v in rows if key == k and v is not None]
        assert n == len(own) and x == pytest.approx(plain(own, p), abs=1e-9)
    assert selection.percentiles(df.where("false"), ["k"], "v", [0.5], most=most).count() == 0


@pytest.mark.parametrize(("most", "parts"), [(0, 7), (150, 5), (10**6, 4)])
def test_percentiles_of_the_past(spark, most, parts, monkeypatch):
    monkeypatch.setattr(prefix_orders, "STEP", 16)
    rows = data(700, 2)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k string, v double").repartition(3)
    got = {r["i"]: (r["p_before"], r["n_before"]) for r in prefix_orders.percentile_before(df, "k", ["i"], "v", 0.25, most=most, parts=parts).collect()}
    past: dict = {}
    assert len(got) == len(rows)
    for i, k, v in sorted(rows):
        own = past.setdefault(k, [])
        p, n = got[i]
        assert n == len(own)
        assert p is None if not own else p == pytest.approx(plain(own, 0.25), abs=1e-9)
        if v is not None:
            own.append(v)


def test_prefix_ranks():
    rng = np.random.default_rng(2)
    for top in (1, 2, 7, 300):
        ranks = rng.integers(0, top, 200)
        stop = rng.integers(1, 201, 400)
        k = (rng.random(400) * stop).astype(np.int64)
        assert prefix_orders.PrefixRanks(ranks).kth(stop, k).tolist() == [sorted(ranks[:s])[j] for s, j in zip(stop.tolist(), k.tolist())]


def pairs(points):
    con = dis = tx = ty = 0
    for i, (a, b) in enumerate(points):
        for c, d in points[:i]:
            s = (a - c) * (b - d)
            con, dis = con + (s > 0), dis + (s < 0)
            tx, ty = tx + (a == c and b != d), ty + (b == d and a != c)
    base = (con + dis + tx) * (con + dis + ty)
    return con, dis, (con - dis) / math.sqrt(base) if base else 0.0


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("kind", ["ties", "few", "line", "empty", "hot"])
def test_rank_correlation(spark, kind, few):
    rng = random.Random(5)
    points = {
        "ties": [(rng.randrange(12), rng.randrange(9)) for _ in range(300)], "few": [(1, 2), (1, 2), (3, 1)], "line": [(i, 3 * i) for i in range(80)], "empty": [],
        "hot": [(rng.random(), 5) for _ in range(150)] + [(7, rng.random() * 9) for _ in range(150)] + [(rng.random() * 9, rng.random() * 9) for _ in range(100)],
    }[kind]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points] + [(None, 1.0), (2.0, None)], "x double, y double").repartition(3)
    got = rank_correlation.kendall_tau(df, "x", "y", parts=6, few=few).first()
    con, dis, tau = pairs(points)
    assert (got["concordant"], got["discordant"], got["n"]) == (con, dis, len(points)) and got["tau"] == pytest.approx(tau)


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 200):
        v, w = rng.integers(0, 20, n), rng.integers(1, 5, n)
        assert rank_correlation.inversions(v, w) == sum(int(w[i] * w[j]) for j in range(n) for i in range(j) if v[i] > v[j])
    assert rank_correlation.inversions(np.array([2, 1]), np.array([2**40, 2**40])) == 2**80
