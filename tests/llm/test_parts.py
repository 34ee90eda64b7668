"""Substring deduplication with far more parts than tasks, and with anchors over many shards."""

import random

import numpy as np
import pytest

from sparkloom.llm import fmindex, packed, repeats, suffixmerge
from sparkloom.llm.packed import unpack
from sparkloom.llm.textvec import anchored, mix, span_hash

from .test_dedup import SCHEMA, brute, corpus


@pytest.mark.parametrize(("unit", "op"), [("word", fmindex.substring_dedup), ("byte", suffixmerge.byte_dedup)])
@pytest.mark.parametrize("hot", [2000, 1])
def test_thousands_of_parts_in_a_few_tasks(spark, monkeypatch, unit, op, hot):
    monkeypatch.setattr(packed, "PART_BYTES", 20)
    monkeypatch.setattr(packed, "MOST_TASKS", 5)
    monkeypatch.setattr(repeats, "LEAST_HOT", hot)
    rows = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert packed.parts_for(df, "text")[0] > 1000
    got = op(df).collect()
    assert sorted(((r["doc_id"], r[f"n_{unit}s"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == [(d, n, k, h) for d, n, k, _, h in brute(rows, unit)]


def run_of(texts, ids):
    """The segments about one line that all texts hold, as one run, the way a collector sends them."""
    codes = mix(np.concatenate([np.array(t, np.uint64) for t in texts]))
    bounds = np.cumsum([0, *map(len, texts)])
    lo, hi, anchor, sums = anchored(codes, bounds, 50, 8)
    doc = np.searchsorted(bounds, lo, "right") - 1
    size = hi - lo + 50
    at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
    numbers = packed.pack([span_hash(sums, anchor, anchor + 8), np.array(ids)[doc], np.zeros(len(lo), np.uint32), (lo - bounds[doc]).astype(np.int32), size.astype(np.uint16), (anchor - lo).astype(np.uint16)])
    return len(numbers).to_bytes(4, "little") + numbers + codes[at].tobytes()


@pytest.mark.parametrize("shard", [300, 2000, 10**9])
def test_an_anchor_over_many_shards(monkeypatch, shard):
    monkeypatch.setattr(fmindex, "SHARD", shard)
    largest, whole = [], fmindex.FMIndex.__init__

    def watched(self, texts, docs, window):
        largest.append(sum(map(len, texts)))
        whole(self, texts, docs, window)

    monkeypatch.setattr(fmindex.FMIndex, "__init__", watched)
    rng = random.Random(3)
    line = [rng.randrange(1 << 40) for _ in range(30)]
    sides = [[rng.randrange(1 << 40) for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(120):  # mostly new surroundings, some that others have on one side or on both
        left = rng.choice(sides) if i % 3 == 0 else [rng.randrange(1 << 40) for _ in range(60)]
        right = rng.choice(sides) if i % 4 == 0 else [rng.randrange(1 << 40) for _ in range(60)]
        texts.append([*left, *line, *right])
    ids = list(range(5, 125))
    gone = {(i, w) for r in fmindex.repeated_in_shards([run_of(texts, ids)], 50) for i, a, z in zip(r[0].tolist(), r[2].tolist(), r[3].tolist(), strict=True) for w in range(a, z)}
    first: dict = {}
    want = set()
    for i, t in zip(ids, texts, strict=True):
        for w in range(len(t) - 49):
            if first.setdefault(tuple(t[w : w + 50]), i) < i:
                want.add((i, w))
    assert gone == want and len(want) > 500
    if shard < 10**9:
        assert max(largest) <= 3 * shard


def test_bundles_keep_every_row():
    rows = [(p, i, bytes([i])) for i, p in enumerate([9, 3, 0, 14, 3, -2, 9])]
    got = packed.bundled(rows, ["bucket", "part", "data"], 5).to_pylist()
    assert {r["task"]: sorted((x["bucket"], x["part"], x["data"]) for x in r["items"]) for r in got} == {4: sorted([(9, 0, b"\0"), (14, 3, b"\3"), (9, 6, b"\6")]), 3: [(3, 1, b"\1"), (3, 4, b"\4")], 0: [(0, 2, b"\2")], -2: [(-2, 5, b"\5")]}
    assert unpack(packed.pack([np.arange(3)]), [np.int64])[0].tolist() == [0, 1, 2]
