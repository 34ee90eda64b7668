"""The pipeline's stages on the smallest data, against brute force where there is one."""

import corpus_pipeline as p
from pyspark.sql import functions as F

from .test_dedup import WORD, links

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    steps = {}
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
        kept.write.parquet(str(tmp_path / name))
        kept = steps[name] = spark.read.parquet(str(tmp_path / name))
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
    left = steps["toxicity"]
    assert clean.join(left, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    want = {d for d, _, c in links(rows, 5, 80) if d == c}
    assert {r["doc_id"] for r in steps["minhash_near_dedup"].collect()} == want
    before = {r["doc_id"]: r["text"] for r in steps["minhash_near_dedup"].collect()}
    seen: dict = {}
    for d in sorted(before):
        w = WORD.findall(before[d] or "")
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), d)
    for r in steps["fm_substring_dedup"].collect():
        w = WORD.findall(before[r["doc_id"]] or "")
        gone = set()
        for i in range(len(w) - 49):
            if seen[tuple(w[i : i + 50])] < r["doc_id"]:
                gone.update(range(i, i + 50))
        assert r["text"] == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else before[r["doc_id"]])
    packed = p.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or n > 2048").count() == 0
