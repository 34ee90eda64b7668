"""Keyed tables and claims: conflicts, repeated batches, files that stay, races and leases."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import claims, ranks
from sparkloom.sources.keyed import Conflict, KeyedTable

SCHEMA = "k long, name string, first_seen string, last_seen string, note string, times long, best double"
RULES = {"first_seen": "first", "note": "filled", "times": "sum", "best": "greatest"}


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", seq int")


def brute(batches):
    """Row by row in order, as single upserts would do it."""
    out = {}
    for rows in batches:
        for k, name, first, last, note, times, best, _ in sorted(rows, key=lambda r: r[-1]):
            if k in out:
                o = out[k]
                out[k] = (k, name, o[2], last, o[4] if note is None else note, o[5] + times, max(x for x in (o[6], best)))
            else:
                out[k] = (k, name, first, last, note, times, best)
    return sorted(out.values(), key=repr)


def table(spark, path, rows=SCHEMA, keys=("k",), buckets=7):
    return KeyedTable(spark, str(path), spark.createDataFrame([], rows).schema, list(keys), buckets)


def contents(t):
    return sorted((tuple(r) for r in t.read().collect()), key=repr)


def folders(t):
    return {r["bucket"]: r["folder"] for r in t.manifest().collect()}


def test_batches_with_conflicts(spark, tmp_path):
    rng = random.Random(1)
    t = table(spark, tmp_path / "t")
    assert contents(t) == []
    batches = [[(rng.choice([None, *range(30)]), f"n{rng.random()}", f"f{i}", f"l{i}", rng.choice([None, f"x{i}"]), rng.randrange(5), rng.random(), i) for i in range(n)] for n in (40, 60, 25)]
    for i, b in enumerate(batches):
        assert t.merge(batch(spark, b).repartition(3), ["seq"], RULES, writer="w", number=i)
        assert contents(t) == brute(batches[: i + 1])
    before, version = folders(t), t.state().version
    assert not t.merge(batch(spark, batches[1]), ["seq"], RULES, writer="w", number=1)
    assert folders(t) == before and t.state().version == version


def test_only_touched_buckets_get_new_files(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=11)
    rows = [(i, "a", "f", "l", None, 1, 0.5, 0) for i in range(200)]
    t.merge(batch(spark, rows), ["seq"], {})
    before, reader = folders(t), t.state()
    assert len(before) == 11
    # replaced by the same values: nothing is new
    assert not t.merge(batch(spark, rows[:50]), ["seq"], {})
    assert folders(t) == before
    # insert or ignore leaves what is there
    assert not t.merge(batch(spark, [(5, "other", "f2", "l2", "z", 9, 9.0, 0)]), ["seq"], {}, default="first")
    assert t.merge(batch(spark, [(5, "other", "f2", "l2", "z", 9, 9.0, 0)]), ["seq"], {})
    after = folders(t)
    assert sum(before[b] != after[b] for b in before) == 1
    assert len(contents(t)) == 200 and t.read().where("k = 5").first()["name"] == "other"
    # a reader of the version before still has its rows
    assert t.read(reader).where("k = 5").first()["name"] == "a"


def test_empty_batches_and_unknown_rules(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert not t.merge(batch(spark, []), ["seq"], {})
    assert not t.merge(batch(spark, []), ["seq"], {}, writer="w", number=4) and t.state().applied == {"w": 4}
    with pytest.raises(ValueError):
        t.merge(batch(spark, []), ["seq"], {"note": "newest"})


def test_a_lost_race_is_run_again(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(batch(spark, [(1, "a", "f", "l", None, 1, 0.0, 0)]), ["seq"], {"times": "sum"})
    threads = [threading.Thread(target=lambda: table(spark, tmp_path / "t").merge(batch(spark, [(1, "a", "f", "l", None, 1, 0.0, 0)]), ["seq"], {"times": "sum"}, tries=20)) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert t.read().first()["times"] == 5
    with pytest.raises(Conflict):
        t.merge(batch(spark, [(1, "b", "f", "l", None, 1, 0.0, 0)]), ["seq"], {}, expect=1)


def test_places_in_a_global_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3])) for i in range(500)]
    got = ranks.numbered(spark.createDataFrame(rows, "i long, x int").repartition(5), ["x", "i"], str(tmp_path / "r"), parts=7).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted((r["rank"], r["i"]) for r in got) == [(n, i) for n, (i, _) in enumerate(want, 1)]
    assert ranks.numbered(spark.createDataFrame([], "i long"), ["i"], str(tmp_path / "e")).count() == 0


def queue_of(spark, n=60):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, ["PENDING", "DONE"][i % 7 == 0], i % 3, day + datetime.timedelta(hours=i * 37 % 50), day + datetime.timedelta(days=9) if i % 5 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, status string, priority int, created_at timestamp, retry_after timestamp"), rows


def test_concurrent_claims_never_share_an_item(spark, tmp_path):
    queue, rows = queue_of(spark)
    log = claims.log(spark, str(tmp_path / "log"), queue, "id", 3)
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    got = {}

    def work(name):
        own = claims.log(spark, str(tmp_path / "log"), queue, "id", 3)
        got[name] = [r["id"] for r in claims.claim(queue, own, [(name, 8)], 1, now, 60, ["priority", "created_at", "id"], str(tmp_path / "s"), caller=name).collect()]

    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    order = [r[0] for r in sorted((r for r in rows if r[1] == "PENDING" and r[4] is None), key=lambda r: (r[2], r[3], r[0]))]
    assert sorted(i for ids in got.values() for i in ids) == sorted(order[:24])
    # the same claim again gives the same items; a new one the next; after the lease they are free again
    again = claims.claim(queue, log, [("w1", 8)], 1, now, 60, ["priority", "created_at", "id"], str(tmp_path / "s"), caller="w1")
    assert sorted(r["id"] for r in again.collect()) == sorted(got["w1"])
    more = claims.claim(queue, log, [("x", 2), ("y", 2)], 1, now, 60, ["priority", "created_at", "id"], str(tmp_path / "s"), caller="boss").collect()
    assert sorted((r["worker"], r["place"], r["id"]) for r in more) == [(w, p, i) for (w, p), i in zip([("x", 1), ("x", 2), ("y", 1), ("y", 2)], order[24:28])]
    late = F.lit("2024-01-03 00:02:00").cast("timestamp")
    freed = claims.claim(queue, log, [("z", 5)], 2, late, 60, ["priority", "created_at", "id"], str(tmp_path / "s"), caller="boss").collect()
    assert sorted(r["id"] for r in freed) == sorted(order[:5])
