"""Centroid clustering against exact Python integers, and against the SQL statement."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa

from sparkloom.llm import centroids, oracles, queries

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [place(v) for _, v in kept]
    out = []
    for (i, _), (d, n) in zip(kept, last):
        out.append((i, n, d, sum(x for x, m in last if m == n), sum(x for x, _ in last), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def vectors(n=200, dim=64, seed=1, scale=1.0):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.gauss(0, scale) for _ in range(dim)]) for i in range(n)]
    # ties: whole coordinates, equal vectors, repeated ids, one without an id
    rows += [(1000 + i, [float(rng.randrange(2)) for _ in range(dim)]) for i in range(40)]
    rows += [(2000 + i, rows[0][1]) for i in range(20)] + [(0, rows[5][1]), (None, rows[6][1])]
    nan, inf = float("nan"), float("inf")
    return rows + [(3000, None), (3001, []), (3002, [1.0] * (dim - 1)), (3003, [None] + [1.0] * (dim - 1)), (3004, [nan] * dim), (3005, [inf] + [0.0] * (dim - 1)), (3006, [0.0] * dim)]


def test_against_exact_integers(spark):
    rows = vectors()
    assert got(centroids.clustered(frame(spark, rows).repartition(5))) == sorted(brute(rows), key=repr)
    assert got(centroids.clustered(frame(spark, rows[:7]))) == sorted(brute(rows[:7]), key=repr)
    assert got(centroids.clustered(frame(spark, [(1, None)]))) == got(centroids.clustered(frame(spark, []))) == []


def test_large_components_stay_exact(spark):
    rows = vectors(60, scale=2e5) + [(5000 + i, [float(10 ** (i % 9)) * (-1) ** j for j in range(64)]) for i in range(30)]
    assert got(centroids.clustered(frame(spark, rows).coalesce(2))) == sorted(brute(rows), key=repr)


def test_screening_leaves_ties_and_near_ties_to_integers():
    rng = np.random.default_rng(0)
    c = rng.integers(-4000, 4000, (16, 64))
    c[9] = c[3]
    v = np.concatenate([(c[3] + c[5]) // 2 + rng.integers(-1, 2, (500, 64)), c, rng.integers(-4000, 4000, (3000, 64)), rng.integers(-(2**26), 2**26, (500, 64))])
    screen = centroids.Screen(c.tolist())
    number, distance = screen.nearest(v)
    d = ((v[:, None] - c) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (distance == d.min(1)).all() and 9 not in number
    assert 0 < screen.recomputed < d.size / 2


def test_rows_that_are_kept():
    kinds = pa.list_(pa.float32())
    column = pa.array([None, [1.0, None], [0.5, -0.5], [float("nan"), 0], [1.0], [1e30, -1e38], [-0.01, 2.0]], kinds)
    own, v = centroids.integers(column, 2)
    assert own.tolist() == [2, 6] and v.tolist() == [[32, -32], [-1, 128]]
    own, v = centroids.integers(column.slice(2), 2)
    assert own.tolist() == [0, 4] and v.tolist() == [[32, -32], [-1, 128]]


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({oracles.OP12})").fetchall()
    assert got(queries.op12_centroid_clustering(spark, sf)) == sorted(want, key=repr)
