"""Deduplicators against brute force, on small documents with every odd case."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from sparkloom.llm import collisions, fmindex, minhash, repeats, suffixmerge
from sparkloom.llm.textvec import anchored, chunks, span_hash, words

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, n_removed string, id string"


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é", "日本", "🙂"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, line = say(70), say(30)
    base = say(200)
    docs = [say(120) + " " + shared + " " + say(40) for _ in range(4)]
    docs += [f"{say(30)}\n{line}\n{say(30)}" for _ in range(6)]
    docs += [base, base, base]
    for k in (1, 2, 3, 8, 20, 60):
        w = base.split(" ")
        for i in rng.sample(range(len(w)), k):
            w[i] = rng.choice(vocab)
        docs.append(" ".join(w))
    docs += ["", None, "one", "one", "two words", "\x00\x1c odd space", "x " * 400, "x " * 300, "x" * 300, "x" * 200, say(3000) + shared]
    rows = [(i * 3 + 1, t, "en", "clash", "clash") for i, t in enumerate(docs)]
    rows += [(None, shared, None, None, None), (rows[0][0], rows[0][1], "en", None, None)]
    rng.shuffle(rows)
    return rows


def brute(rows, unit):
    seen: dict = {}
    split = (lambda t: t.encode()) if unit == "byte" else WORD.findall
    for d, t, *_ in rows:
        w = split(t or "")
        if d is not None:
            for i in range(len(w) - 49):
                seen[tuple(w[i : i + 50])] = min(d, seen.get(tuple(w[i : i + 50]), d))
    out = []
    for d, t, *_ in rows:
        w = split(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and seen[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        raw = bytes(kept) if unit == "byte" else " ".join(kept).encode()
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(w), sum(gone), spans, hashlib.sha256(raw).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 1])
def test_word_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "LEAST_HOT", hot)
    monkeypatch.setattr(repeats, "HOT_SHARE", 128 if hot > 1 else 1 << 40)
    rows = corpus()
    got = fmindex.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(d, n, k, h) for d, n, k, _, h in brute(rows, "word")]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == want
    assert sum(r["n_removed"] for r in got) > 500


@pytest.mark.parametrize("hot", [2000, 1])
def test_byte_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "LEAST_HOT", hot)
    monkeypatch.setattr(repeats, "HOT_SHARE", 128 if hot > 1 else 1 << 40)
    rows = corpus(5)
    got = suffixmerge.byte_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == brute(rows, "byte")


def test_rows_that_repeat_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, b), (3, f"x y {a}"), (3, f"{b} z")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in fmindex.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0), (2, 60, 0), (3, 61, 60), (3, 62, 60)]


def twice():
    """Documents that hold a repeated passage more than once, between equal passages of their own."""
    rng = random.Random(11)
    say = lambda n: " ".join("v%d" % rng.randrange(10**6) for _ in range(n))
    p, x, y, short = say(60), say(60), say(60), say(25)
    docs = [p, f"{x} {p} {y} {x} {p} {y}", f"{y} {p} {x} {y} {p} {x} {y} {p} {x}", f"{short} {say(60)}", f"{x} {short} {y} " * 3, " ".join([say(30), p] * 2), f"{x} {p} {y} {x} {p} {y}"]
    rows = [(i + 1, t, "en", None, None) for i, t in enumerate(docs)]
    return [*rows, (2, f"{say(20)} {x} {p} {y} {x} {p} {y}", "en", None, None)]


@pytest.mark.parametrize("hot", [2000, 1])
@pytest.mark.parametrize(("unit", "op"), [("word", fmindex.substring_dedup), ("byte", suffixmerge.byte_dedup)])
def test_passages_that_a_document_repeats(spark, monkeypatch, unit, op, hot):
    monkeypatch.setattr(repeats, "LEAST_HOT", hot)
    monkeypatch.setattr(repeats, "HOT_SHARE", 128 if hot > 1 else 1 << 40)
    rows = twice()
    got = op(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r[f"n_{unit}s"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == [(d, n, k, h) for d, n, k, _, h in brute(rows, unit)]
    if unit == "word":
        assert (2, 120) in {(r["doc_id"], r["n_removed"]) for r in got}


def test_kept_text_replaces_only_what_changed(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, 5, "k"), (2, f"new  start {a} end", 9, None), (3, "two  spaces", 11, "k"), (4, None, None, "k"), (None, a, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept_text string")
    got = {r["doc_id"]: r for r in fmindex.without_repeats(docs).collect()}
    assert got[2]["text"] == "new start end" and got[2]["n_chars"] == 13
    assert got[3]["text"] == "two  spaces" and got[3]["n_chars"] == 11 and got[4]["text"] is None
    assert got[1]["text"] == a and got[None]["text"] == a and got[1]["kept_text"] == "k"


@pytest.mark.parametrize("op", [fmindex.substring_dedup, suffixmerge.byte_dedup, minhash.near_duplicates])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def links(rows, size, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {d: d for d, *_ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, *_) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            if d is None or e is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None) for (d, *_), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 512), (5, 80, 2)])
def test_near_duplicates(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", block)
    monkeypatch.setattr(minhash, "LIST_BLOCK", block)
    rows = [r for r in corpus(9)]
    rows += [(900 + i, (rows[i][1] or "").upper(), None, None, None) for i in range(6)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), size, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == links(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_filter_keeps_columns_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(2, text, "a"), (1, text + " end", "b"), (None, text, "c"), (5, "", "d"), (6, None, "e")]
    got = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept_id string"))
    assert sorted(r["kept_id"] for r in got.collect()) == ["b", "c", "d", "e"]


def test_least_matches_leaves_almost_no_pair_behind():
    t = minhash.least_matches(0.85)
    rng = np.random.default_rng(0)
    assert (rng.binomial(minhash.COORDINATES, 0.85, 1_000_000) >= t).all()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = []
    for i, b in enumerate(base):
        for k in range(5):
            rows.append((len(rows) * 2, [float(x) for x in b + rng.standard_normal(16) * 0.02 * k * (i % 3)], i % 2))
    rows += [(500, rows[0][1], 0), (502, [2 * x for x in rows[0][1]], 0), (504, rows[0][1], 1), (506, None, 0), (508, [0.0] * 16, 0), (510, rows[0][1], None), (512, [float("nan")] * 16, 0), (514, [None] + rows[0][1][1:], 0), (516, rows[0][1][:8], 0), (518, [], 0), (None, rows[0][1], 0)]
    got = {r["vec_id"]: r for r in collisions.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert len(got) == len(rows)
    ok = [(d, np.array(v), y) for d, v, y in rows if d is not None and v and None not in v and y is not None and np.isfinite(v).all() and np.any(v)]
    n, root = collections.Counter(), {d: d for d, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, v, y) in enumerate(ok):
        for e, w, z in ok[:i]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                n[d] += 1
                n[e] += 1
                x, k = sorted((find(d), find(e)))
                root[k] = x
    for d, *_ in rows:
        assert got[d]["n_links"] == n[d], d
        assert got[d]["component_id"] == (find(d) if d is not None else None)
        assert got[d]["kept"] == (d is None or find(d) == d)


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 5, n).astype(np.uint64) for n in (40, 3, 60, 25, 1)]
    index = fmindex.FMIndex(texts, np.array([9, 4, 7, 2, 5]), 6)
    other = [rng.integers(0, 6, 50).astype(np.uint64), np.array([99], np.uint64), texts[2]]
    length, least = index.matching_statistics(other)
    at = 0
    for q in other:
        for i in range(len(q)):
            best, doc = 0, -1
            for t, d in zip(texts, (9, 4, 7, 2, 5)):
                for j in range(len(t)):
                    k = 0
                    while k < 6 and i + k < len(q) and j + k < len(t) and q[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
                    if k == 6:
                        doc = d if doc < 0 else min(doc, d)
            assert (length[at], least[at]) == (best, doc)
            at += 1


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(k)]
        coded = [suffixmerge.front_code(r) for r in runs]
        assert [[x for x, _ in suffixmerge.decoded(c)] for c in coded] == runs
        seen, out, last = [0] * k, [], b""
        for r, lcp in suffixmerge.merge([suffixmerge.decoded(c) for c in coded]):
            x = runs[r][seen[r]]
            seen[r] += 1
            assert lcp == suffixmerge.shared(last, x)
            out.append(x)
            last = x
        assert out == sorted(x for r in runs for x in r)


def test_words_and_anchors():
    import pyarrow as pa

    texts = ["a  b\tc", "", None, " x\x1cy z", "q" * 10]
    arr = pa.array(texts)
    for _, off, data in chunks(arr, arr):
        _, starts, stops, bounds = words(data, off)
        got = [[data[s:e].tobytes().decode() for s, e in zip(starts[i:j], stops[i:j])] for i, j in zip(bounds[:-1], bounds[1:])]
        assert got == [WORD.findall(t or "") for t in texts]
    rng = np.random.default_rng(0)
    body = rng.integers(0, 4, 80).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = np.concatenate([rng.integers(9, 99, 30).astype(np.uint64), body])
    two = np.concatenate([rng.integers(9, 99, 7).astype(np.uint64), body])
    keys = []
    for v in (one, two):
        lo, hi, at, sums = anchored(v, np.array([0, len(v)]), 50, 8)
        shift = len(v) - 80
        keys.append({(s - shift, int(span_hash(sums, np.array([a]), np.array([a + 8]))[0]), a - shift) for l, h, a in zip(lo, hi, at) for s in range(l, h + 1) if s >= shift})
    assert keys[0] == keys[1] and len(keys[0]) == 31


def test_many_near_copies_meet_through_their_first(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 20)
    monkeypatch.setattr(minhash, "STAR", 16)
    rng = random.Random(21)
    base = ["w%d" % rng.randrange(10**6) for _ in range(300)]
    rows = [(i, " ".join(base[:i] + ["x%d" % i] + base[i + 1 :])) for i in range(150)] + [(200 + i, " ".join("y%d" % rng.randrange(10**6) for _ in range(50))) for i in range(30)]
    rows += [(7, "another text under the same id, that no one else has"), (300, " ".join(base[:150] + ["z%d" % i for i in range(150)]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 200} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] >= 200)


def test_recall_of_vector_links_on_the_table(spark):
    """What brute force links among the embeddings of the smallest data and near copies of them, just at the threshold and above, is found."""
    rng = np.random.default_rng(12)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding").where("label is not null").collect()
    data = [(r["vec_id"], str(r["label"]), [float(x) for x in r["embedding"]]) for r in table if r["embedding"]]
    for i, (_, label, v) in enumerate(data[:200]):
        for k in range(3):
            noise = rng.standard_normal(len(v))
            near = np.array(v) + noise / np.linalg.norm(noise) * np.linalg.norm(v) * rng.choice([0.1, 0.15, 0.19, 0.2, 0.203])
            data.append((10**6 + 3 * i + k, label, near.tolist()))
    unit = np.array([np.array(v) / np.linalg.norm(v) for *_, v in data])
    label = np.array([x for _, x, _ in data])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    want = dict(zip((i for i, *_ in data), (linked.sum(1) - 1).tolist(), strict=True))
    got = {r["vec_id"]: r["n_links"] for r in collisions.near_vectors(spark.createDataFrame(data, "vec_id long, label string, embedding array<double>")).collect()}
    assert sum(want.values()) > 300 and all(got[i] <= n for i, n in want.items())
    assert sum(got[i] for i in want) >= 0.999 * sum(want.values())


def test_collisions_are_counted_inside_the_windows():
    rng = np.random.default_rng(4)
    for n, m in ((20, 30), (80, 90)):
        left, right = rng.standard_normal((n, 6)), rng.standard_normal((m, 6))
        assert (collisions.collisions(left, right, 0.3) == (np.abs(left[:, None] - right[None]) <= 0.3).sum(2)).all()
