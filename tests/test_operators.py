"""Rules of single operators on small literal inputs."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stats, text, urls
from sparkloom.operators import detectors, sequences, vetting
from sparkloom.sources import export, jsonl, warc


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(col.alias("x")).first()[0]


def test_lifecycle_counts_gaps_over_seven_days_only(spark):
    d = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rows = spark.createDataFrame([("a", d(0)), ("a", d(0)), ("a", d(7)), ("a", d(15)), ("b", d(3)), ("b", None)], "k string, day date")
    got = {r["k"]: r for r in sequences.lifecycles(rows, ["k"], "day").collect()}
    assert (got["a"]["times_seen"], got["a"]["times_reposted"]) == (3, 1)
    assert got["a"]["latest_days"] == [d(0), d(7), d(15)]
    assert (got["b"]["times_seen"], got["b"]["times_reposted"]) == (1, 0)


def test_wilson_and_fisher(spark):
    rows = spark.createDataFrame([("t", 3, 1, 1, 3), ("u", 0, 5, 5, 0), ("v", 0, 0, 2, 1)], "key string, a long, b long, c long, d long")
    p = {r["key"]: r["p_value"] for r in stats.fisher_exact(rows).collect()}
    assert p["t"] == pytest.approx(34 / 70)
    assert p["u"] == pytest.approx(2 / 252)
    assert p["v"] == pytest.approx(1.0)
    low, high = stats.wilson(F.col("k"), F.col("n"))
    assert one(spark, low, k=0, n=10) == 0.0
    assert one(spark, high, k=0, n=10) == pytest.approx(0.27754, abs=1e-4)
    assert one(spark, low, k=0, n=0) is None


def test_text_measures(spark):
    w = F.col("w")
    for word, n in {"table": 1, "apple": 1, "reading": 2, "idea": 2, "e": 1, "123": 0, "queue": 1}.items():
        assert one(spark, text.syllables(w), w=word) == n, word
    assert one(spark, text.entropy(w), w="abab") == pytest.approx(1.0)
    assert one(spark, text.role_keywords(w), w="The running Companies of boxes and classes") == ["runn", "company", "box", "class"]
    assert one(spark, text.looks_random(w), w="xkcdqrst")
    assert not one(spark, text.looks_random(w), w="engineering")


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.normalised(u), u="HTTP://Ex.com/a/?b=2&utm_source=x&a=1&c=#f") == "http://ex.com/a?a=1&b=2"
    assert one(spark, urls.canonical(u), u="http://Ex.com:80?b=2&a=1#f") == "http://ex.com/?a=1&b=2"
    assert one(spark, urls.normalised(u), u="not a url") is None
    assert one(spark, urls.host_suffixes(F.col("h")), h="a.b.com") == ["a.b.com", "b.com", "com"]
    assert one(spark, urls.company_label(F.col("h")), h="jobs.acme.com") == "acme"


def test_vetting_scores_only_what_came_before_the_first_failure(spark):
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id long, x long")
    rules = [vetting.Rule("A", F.lit(True), "no", 1.0, 0.3), vetting.Rule("B", F.col("x") < 10, "big", 1.0, 0.3), vetting.Rule("C", F.lit(True), "no", 1.0, 0.3)]
    got = {r["id"]: (r["passed"], r["reason"], round(r["fit_score"], 3)) for r in vetting.vet(rows, rules).collect()}
    assert got == {1: (True, None, 0.9), 2: (False, "B: big", 0.3), 3: (False, "B: big", 0.3)}


def test_detectors(spark):
    rows = spark.createDataFrame(
        [(1, "Junior developer", "Recent graduate wanted, digital native, 6+ years of experience", 30_000, 95_000), (2, "Cook", "We cook.", None, None)],
        "id long, title string, text string, lo long, hi long",
    )
    title, body = F.col("title"), F.col("text")
    found = detectors.run(rows, "id", [*detectors.age_patterns(body), detectors.entry_contradiction(title, body), detectors.wide_range(F.col("lo"), F.col("hi"))])
    got = sorted((r["id"], r["signal_type"], r["severity"]) for r in found.collect())
    assert got == [(1, "DISC-02", "violation"), (1, "DISC-02", "violation"), (1, "DISC-06", "violation"), (1, "QS-02", "violation"), (1, "ST-02", "violation")]
    comp = found.where("signal_type = 'DISC-06'").first()["confidence"]
    assert comp == pytest.approx(min(0.95, math.sqrt(0.85 * 0.75) * 1.3))
    ids = detectors.with_ids(found, "id", F.lit("2024-01-01"))
    assert ids.count() == 4


def test_json_lines_skip_bad_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    jsonl.append(rows, str(tmp_path / "x"))
    (tmp_path / "x" / "bad.json").write_text("{not json\n")
    good, bad = jsonl.read(spark, str(tmp_path / "x"), rows.schema)
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, None)]
    assert bad.count() == 1


def test_archive_round_trip(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.record("response", "http://x/", "2024-01-01", b"body") + warc.record("response", "http://y/", "2024-01-02", b""))
    (tmp_path / "b.warc.gz").write_bytes(b"\x1f\x8bbroken")
    got = sorted(((r["uri"], bytes(r["payload"]) if r["payload"] is not None else None, r["error"]) for r in warc.read(spark, str(tmp_path)).collect()), key=repr)
    assert ("http://x/", b"body", None) in got
    assert ("http://y/", b"", None) in got
    assert len(got) == 3 and any(e for *_, e in got)


def test_export_detects_tampering(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) s")
    path = str(tmp_path / "t")
    export.write_table(rows, ["id"], path)
    want = export.row_digest(rows).first()
    assert export.verify(spark, path, "parquet", rows.schema, want["n"], want["digest"]) == []
    assert export.verify(spark, path, "parquet", rows.schema, 99, "x") != []
    assert len(export.digest(export.file_hashes(spark, path))) == 64


def test_smoothed_stream_equals_batch(spark, tmp_path):
    from sparkloom.streaming import ingest

    rows = spark.createDataFrame([(k, i, float(i * k)) for i in range(20) for k in (1, 2)], "k long, i long, v double")
    rows.where("i < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("i >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = ingest.smoothed(ingest.read_folder(spark, str(tmp_path / "in"), rows.schema, 1), "k", "i", "v", 0.3)
    q = out.writeStream.format("memory").queryName("smoothed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["key"]: r["ema"] for r in spark.sql("select key, max_by(ema, n) ema from smoothed group by key").collect()}
    want = {r["k"]: r["ema"] for r in sequences.ema(rows, "k", ["i"], "v", 0.3).collect()}
    assert last == pytest.approx(want)
