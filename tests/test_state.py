"""Keyed state over streams: any order of files gives what the batch gives; repeated starts and forgetting."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, sequences
from sparkloom.streaming import ingest, state


def source(spark, path, rows, schema, files, a_batch):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(str(path))
    return ingest.read_folder(spark, str(path), spark.createDataFrame([], schema).schema, a_batch)


def test_lifecycles_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *(f"2024-{rng.randrange(1, 4):02d}-{rng.randrange(1, 29):02d}" for _ in range(9))])) for _ in range(400)]
    schema = "k string, day string"
    stream = source(spark, tmp_path / "in", rows, schema, 6, 2).select("k", F.to_timestamp("day").alias("ts"))
    table = state.lifecycles(stream, ["k"], "ts", str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r["k"]: r for r in table.read().collect()}
    want = sequences.lifecycles(spark.createDataFrame(rows, schema).withColumn("d", F.to_date("day")), ["k"], "d").collect()
    assert len(want) == len(got)
    for r in want:
        g = got[r["k"]]
        assert (g["times_seen"], g["times_reposted"]) == (r["times_seen"], r["times_reposted"])
        assert g["latest_days"].split(",") == [str(x) for x in r["latest_days"]]
    # nothing new: no version more; a new day: one key changes
    version = table.state().version
    state.lifecycles(stream, ["k"], "ts", str(tmp_path / "t"), str(tmp_path / "c"))
    assert table.state().version == version
    source(spark, tmp_path / "in", [("b", "2023-01-01"), ("a", rows[0][1])], schema, 1, 2)
    state.lifecycles(stream, ["k"], "ts", str(tmp_path / "t"), str(tmp_path / "c"))
    b = table.read().where("k = 'b'").first()
    assert b["times_seen"] == got["b"]["times_seen"] + 1 and b["times_reposted"] == got["b"]["times_reposted"] + 1


def test_two_levels_of_sameness(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randrange(90), rng.choice([None, "s", "s", "s", "t", "u"]), rng.choice(["x", "x", "y", "z", None])) for i in range(300)]
    schema = "id long, arrival long, sig string, url string"
    stream = source(spark, tmp_path / "in", rows, schema, 8, 3)
    args = ("id", F.col("arrival"), F.col("url"), F.col("sig"), str(tmp_path / "t"), str(tmp_path / "c"))
    table = state.seen_set(stream, *args)
    got = {r["sig"]: (r["kept_id"], r["n_rows"], r["n_exact"], r["n_signature"]) for r in table.read().collect()}
    want = {}
    for s in ("s", "t", "u"):
        own = sorted((a, i, u or "") for i, a, sig, u in rows if sig == s)
        exact = sum(u == own[0][2] for _, _, u in own)
        want[s] = (own[0][1], len(own), exact - 1, len(own) - exact)
    assert got == want
    stats = aggregates.dedup_stats(spark.createDataFrame(rows, schema).where("sig is not null").select("sig", F.coalesce("url", F.lit("")).alias("url"), F.struct("arrival", "id").alias("o")), "url", "sig", "o").first()
    assert (stats["exact_duplicates"], stats["signature_duplicates"]) == (sum(w[2] for w in want.values()), sum(w[3] for w in want.values()))


def test_signatures_are_forgotten(spark, tmp_path):
    schema = "id long, arrival long, sig string, url string"
    args = ("id", F.col("arrival"), F.col("url"), F.col("sig"), str(tmp_path / "t"), str(tmp_path / "c"), 500)
    table = state.seen_set(source(spark, tmp_path / "in", [(1, 1, "s", "x")], schema, 1, 1), *args)
    assert table.read().first()["kept_id"] == 1
    time.sleep(1)
    # the timer runs in the next micro-batch, after its rows: what comes then still meets the old row
    state.seen_set(source(spark, tmp_path / "in", [(2, 2, "other", "x")], schema, 1, 1), *args)
    state.seen_set(source(spark, tmp_path / "in", [(3, 3, "s", "x")], schema, 1, 1), *args)
    assert table.read().where("sig = 's'").first()["kept_id"] == 3


def test_a_new_signature_costs_the_state_three_calls():
    calls = []

    class Held:
        def __init__(self):
            self.rows = {}

        def __getattr__(self, name):
            raise AssertionError(f"{name} is a call too many")

        def get(self):
            calls.append("get")
            return self.rows.get(None)

        def update(self, row):
            calls.append("update")
            self.rows[None] = row

        def getValue(self, key):
            calls.append("getValue")
            return self.rows.get(key)

        def updateValue(self, key, row):
            calls.append("updateValue")
            self.rows[key] = row

    seen = state.Seen(None)
    seen.counts, seen.kept = Held(), Held()
    take = lambda *rows: next(seen.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["arrival", "id", "url", "n"])]), None)).to_dict("records")
    assert take((5, 50, "x", 2)) == [{"sig": "s", "kept_id": 50, "url": "x", "n_rows": 2, "n_exact": 1, "n_signature": 0}]
    assert len(calls) == 3
    assert take((6, 60, "y", 3), (7, 70, "x", 1)) == [{"sig": "s", "kept_id": 50, "url": "x", "n_rows": 6, "n_exact": 2, "n_signature": 3}]
    assert take((1, 10, "y", 1)) == [{"sig": "s", "kept_id": 10, "url": "y", "n_rows": 7, "n_exact": 3, "n_signature": 3}]
    assert take((2, 20, "z", 4)) == [{"sig": "s", "kept_id": 10, "url": "y", "n_rows": 11, "n_exact": 3, "n_signature": 7}]
