"""Attribution, licenses, packing, toxicity, fingerprints and segmentations on small inputs."""

import hashlib
import os
import random
import zlib
from math import exp

import numpy as np
import pytest

from sparkloom.llm import attribution, licenses, merkle, packing, queries, segmentations, toxicity
from sparkloom.llm.common import Scratch, components, vocabulary
from sparkloom.llm.wordbpe import encoder

ODD = [None, "", "one", "a\n\nb\n", "é日本🙂\nx", "tab\tand\x1csep", "y " * 5000, "x" * 20_000]


def frame(spark, texts, extra=True):
    rows = [(i, t, "s", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, length double")


def test_tokens_add_up_and_boundaries_follow_the_rule(spark):
    got = attribution.token_counts(frame(spark, ODD)).collect()
    enc, size = attribution.encoder(vocabulary("byte_bpe_50k.tiktoken"))
    for i, t in enumerate(ODD):
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in own) == len(enc.encode(t or ""))
        assert sum(r["n_bytes"] for r in own) == len((t or "").encode())
        assert max(r["stop_char"] for r in own) == len(t or "")
    # a token of 4 bytes over sections of 1 and 3 goes to the second, one of 2 over 1 and 1 to the first
    given, touch, cross = attribution.attribute(np.array([2, 6, 8]), np.array([0, 3, 7]), 8)
    assert given.tolist() == [1, 2, 0] and touch.tolist() == [2, 2, 1] and cross.tolist() == [1, 2, 1]


def test_tokens_of_every_section_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "the ", " word", "\n", "\n\n", " \n ", "é", "日本", "🙂", "1,2", "'s", "\r\n", "  "]) for _ in range(rng.randrange(120))) for _ in range(40)]
    got = attribution.token_counts(frame(spark, texts)).collect()
    enc, size = attribution.encoder(vocabulary("byte_bpe_50k.tiktoken"))
    for i, t in enumerate(texts):
        owner = [k for k, line in enumerate(x + b"\n" for x in t.encode().split(b"\n")) for _ in line][: len(t.encode())]
        want, touch, at = [0] * (max(owner, default=0) + 1), [0] * (max(owner, default=0) + 1), 0
        for token in enc.encode(t):
            own = owner[at : at + int(size[token])]
            at += int(size[token])
            want[max(sorted(set(own)), key=own.count)] += 1
            for k in set(own):
                touch[k] += 1
        rows = sorted((r["section"], r["n_tokens"], r["n_touching"]) for r in got if r["doc_id"] == i)
        assert rows == [(k, a, b) for k, (a, b) in enumerate(zip(want, touch, strict=True))]


def test_long_blank_runs_keep_their_tokens(spark):
    import tiktoken

    enc, _ = attribution.encoder(vocabulary("byte_bpe_50k.tiktoken"))
    for blank in (" ", "\n", " \n\t", "\u3000"):
        for text in (blank * 5000, f"a{blank * 5000}b", f"a{blank * 5000} b {blank * 6000}", f"{blank * 4096}'s x"):
            assert enc.encode(text) == enc.plain(text)
    assert isinstance(enc.plain.__self__, tiktoken.Encoding)
    got = attribution.token_counts(frame(spark, [" " * 1_000_000, "x" + " " * 1_000_000 + "y"])).collect()
    assert sorted(r["n_tokens"] for r in got)[0] > 900_000


@pytest.mark.parametrize("op", [attribution.token_counts, licenses.license_scan, merkle.fingerprints, packing.pack, lambda d: segmentations.sampled(d, ["doc_id"])])
def test_empty_tables(spark, op):
    assert op(frame(spark, [])).count() == 0


def test_licenses(spark):
    apache = licenses.NOTICES["Apache-2.0"]
    texts = [*ODD, f"head\n{apache}\ntail", apache.replace("the Apache", "an apache"), "Licensed under nothing at all", f"{apache} and {apache}", licenses.NOTICES["BSD-3-Clause"].replace("forms, with", "forms,\nwith  ")]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    n = len(ODD)
    assert all(got[i]["n_found"] == 0 for i in range(n))
    assert (got[n]["license"], got[n]["coverage"]) == ("Apache-2.0", 1.0)
    one = got[n]["found"][0]
    assert texts[n][one["start"] : one["stop"]] == apache[:-1]
    assert got[n + 1]["license"] == "Apache-2.0" and got[n + 1]["coverage"] == 0.875
    assert got[n + 2]["n_found"] == 0 and got[n + 3]["n_found"] == 2
    assert got[n + 4]["license"] == "BSD-3-Clause"


def test_alignment_is_increasing_and_complete_on_equal_texts():
    rng = random.Random(0)
    for _ in range(50):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(20))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(20))]
        pairs = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(licenses.align(a, a)) == len(a)


def test_packing(spark):
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "Beta,", "12", "don't"]) for _ in range(rng.randrange(3000))) for _ in range(60))]
    docs = frame(spark, texts)
    got = packing.pack(docs.unionByName(docs.limit(0))).collect()
    enc = encoder(vocabulary("word_bpe_49k.json"))
    total, spots = 0, {}
    for i, t in enumerate(texts):
        ids = [*enc.slow.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["length"] for r in own] == [len(ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
        for k, r in enumerate(own):
            assert r["start"] == 2048 * k
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[2048 * k : 2048 * (k + 1)], "<u4").tobytes())
            spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += len(ids)
    for parts in spots.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(spots) <= -(-total // 2048) * 1.05 + 1
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plans_fill_every_length_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, rng.geometric(1 / (5 + 10 * seed), 500))
    counts = np.bincount(lengths, minlength=65)
    spots = {}
    for n, runs in packing.plan(counts, 64).items():
        stops = np.append(runs[1:, 0], counts[n])
        for (rank, seq, off), stop in zip(runs, stops):
            for k in range(stop - rank):
                spots.setdefault(seq + k, []).append((off, n))
    assert sum(map(len, spots.values())) == 500
    for parts in spots.values():
        at = 0
        large = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
            large += n > 64 // 3
        assert at <= 64 and large <= 2


def labelled(spark, n=600):
    rng = random.Random(7)
    vocab = [a + b for a in ("ba", "ko", "mi", "ru", "se") for b in ("lan", "tor", "vex", "din", "sum", "pol")]
    bad = ["zgrub", "zgrot", "vilk"]
    rows, marks = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "en", "ish"]))
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    rows += [(n, None), (n + 1, ""), (n + 2, "ba " * 20_000)]
    marks += [(n, None), (n + 9, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


def test_toxicity_on_held_out_documents(spark):
    docs, labels, marks = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [d for d in marks if marks[d] is not None and d in got and zlib.crc32(str(d).encode()) % 4 == 2]
    right = sum((got[d]["score"] >= 0.3) == marks[d] for d in held) / len(held)
    assert right > 0.97
    hit = next(r for d, r in got.items() if marks.get(d) == 1)
    text = docs.where(f"doc_id = {hit['doc_id']}").first()["text"]
    assert all(text[s["start"] : s["stop"]].startswith(("zg", "vilk")) for s in hit["toxic_spans"]) and hit["toxic_spans"]
    assert got[600]["score"] < 0.3 and got[601]["score"] == got[600]["score"]
    # stretches about evidence against chains over whole texts
    for r in docs.limit(60).collect():
        e = np.array([model.emission(w) for w in toxicity._TOKEN.findall(r["text"] or "")], dtype=float)
        if len(e):
            stops = np.array([len(e)])
            whole = toxicity.forward_backward(e[None, :], stops, model.transition)[0][0]
            part = toxicity.token_marginals(e, stops, model)
            a, b = (1 / (1 + np.exp(-toxicity.summary(p, stops) @ model.logistic)) for p in (whole, part))
            assert abs(a - b)[0] < 0.02
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 600").count() == 3


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, 20)
    got = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).select("score").distinct().collect()
    assert len(got) == 1
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    e, t = rng.standard_normal((3, 5)), rng.standard_normal((2, 2))
    lengths = np.array([5, 3, 1])
    p, pairs = toxicity.forward_backward(e, lengths, t)
    want = np.zeros((2, 2))
    for r, n in enumerate(lengths):
        weight = {}
        for m in range(2**n):
            y = [(m >> i) & 1 for i in range(n)]
            weight[tuple(y)] = exp(sum(e[r, i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        z = sum(weight.values())
        for i in range(n):
            assert p[r, i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += w / z
    assert pairs == pytest.approx(want)


def test_fingerprints(spark):
    texts = [*ODD, "same text here", "same text here", *("word%d " % i * 40 for i in range(12))]
    rows = [(10 * i, t, "s", 1.0) for i, t in enumerate(texts)]
    got = sorted(merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, look string, ord double")).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    plain = [t or "" for t in texts]
    for i, r in enumerate(got):
        t, after = plain[i], plain[(i + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(merkle.likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(merkle.likeness(r["fingerprint"], got[(i + 1) % len(got)]["fingerprint"]))
        assert (r["fingerprint"] == got[(i + 1) % len(got)]["fingerprint"]) == (t == after)
    assert merkle.fingerprints(frame(spark, [])).count() == 0
    alone = merkle.fingerprints(frame(spark, ["just one document"])).collect()
    assert alone[0]["near_next"] == 1.0


def test_fingerprints_lose_no_row_and_find_successors_at_any_id(spark):
    for base, step in ((2**60 + 1, 3), (2**63 - 401, 1), (-(2**63), 1), (-200, 1)):
        rows = [(base + step * i, f"text number {i} " * (1 + i % 5)) for i in range(400)]
        got = sorted(merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
        assert [r["doc_id"] for r in got] == [r[0] for r in rows]
        for i, r in enumerate(got):
            t, after = rows[i][1], rows[(i + 1) % 400][1]
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()


def test_likeness_against_exact_values(spark):
    rng = random.Random(8)
    say = lambda n: " ".join("w%d" % rng.randrange(10**5) for _ in range(n))
    lines = [say(30) for _ in range(40)]
    base = "\n".join(lines)
    grams = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    for k in (1, 5, 20, 40):
        other = "\n".join([*lines[: 40 - k], *(say(30) for _ in range(k))])
        a, b = (merkle.written(merkle.tree(t), merkle.sketches([t])[0]) for t in (base, other))
        ga, gb = grams(base.encode()), grams(other.encode())
        assert merkle.likeness(a, b) == pytest.approx(len(ga & gb) / len(ga | gb), abs=0.16)
        assert merkle.differing_branches(merkle.read(a)[0], merkle.read(b)[0]) == [(0, p) for p in range(40 - k, 40)]
        assert merkle.shared_bytes(merkle.tree(base), merkle.tree(other)) == sum(len(x) + 1 for x in lines[: 40 - k])
    assert merkle.read(a)[0] == merkle.tree(base)


def test_tree_locates_edits():
    a = "title\n\nfirst\nsecond\n\nthird\n"
    assert merkle.differing_branches(merkle.tree(a), merkle.tree(a)) == []
    assert merkle.differing_branches(merkle.tree(a), merkle.tree(a.replace("second", "2nd"))) == [(1, 1)]
    assert merkle.tree("a\nb").root != merkle.tree("a\n\nb").root


def test_segmentations(spark):
    texts = ["", None, "the a", "  two  spaces ", "日本🙂\x00", "x" * 3000, "plain words here", "plain words here"]
    rows = spark.createDataFrame([(i // 2, i % 2, t, "s") for i, t in enumerate(texts)], "conv_id long, turn long, text string, sample string")
    got = segmentations.sampled(rows.drop("sample"), ["conv_id", "turn"], k=3, ids=True).collect()
    m = segmentations.model(vocabulary("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        own = [r for r in got if (r["conv_id"], r["turn"]) == (i // 2, i % 2)]
        assert len({tuple(r["ids"]) for r in own}) == len(own) >= 1
        assert all(r["round_trip"] and m.decode(list(r["ids"])) == (t or "") and 0 <= r["inclusion"] <= 1 for r in own)
    again = segmentations.sampled(rows.drop("sample").repartition(3), ["conv_id", "turn"], k=3, ids=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    plain = segmentations.decoded(segmentations.encoded(rows, ["conv_id", "turn"]), ["conv_id", "turn"]).collect()
    assert sorted(r["text"] for r in plain) == sorted(t or "" for t in texts)


def steps_of(m, word):
    """For each position of a word its pieces (stop, ids, log probability given the position), by the definition."""
    n = len(word)
    edges = []
    for i in range(n):
        here = [(j, (m.weight[word[i:j]][0],), m.weight[word[i:j]][1]) for j in range(i + 1, n + 1) if word[i:j] in m.weight]
        if not here or here[0][0] != i + 1:
            raw = word[i].encode()
            here.insert(0, (i + 1, tuple(m.byte[b] for b in raw), m.byte_weight * len(raw)))
        edges.append(here)
    after = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        sums = [w + after[j] for j, _, w in edges[i]]
        after[i] = np.logaddexp.reduce(sums)
        edges[i] = [(j, ids, x - after[i]) for (j, ids, _), x in zip(edges[i], sums, strict=True)]
    return edges


@pytest.mark.parametrize("text", ["the", "or a", "日x"])
def test_sampling_follows_the_lattice_without_replacement(text):
    m = segmentations.SubwordModel(vocabulary("piece_bpe_32k.model"), 0.2)
    paths = {(): 0.0}
    for chunk in m.words(text):
        steps, own = steps_of(m, chunk), {}

        def walk(at, ids, w, steps=steps, own=own):
            if at == len(steps):
                own[tuple(ids)] = w
            else:
                for j, more, x in steps[at]:
                    walk(j, [*ids, *more], w + x)

        walk(0, [], 0.0)
        paths = {a + b: x + y for a, x in paths.items() for b, y in own.items()}
    assert sum(map(exp, paths.values())) == pytest.approx(1)
    first, weight, n = dict.fromkeys(paths, 0), dict.fromkeys(paths, 0.0), 4000
    for got in segmentations.sample_batch(m, [text] * n, np.arange(n), 3):
        assert len({tuple(ids) for ids, *_ in got}) == len(got) == min(3, len(paths))
        first[tuple(got[0][0].tolist())] += 1
        for ids, w, share in got:
            assert w == pytest.approx(paths[tuple(ids.tolist())])
            weight[tuple(ids.tolist())] += exp(w) / share / n
    for p, w in paths.items():
        assert first[p] / n == pytest.approx(exp(w), abs=0.03)
        assert weight[p] == pytest.approx(exp(w), abs=0.05)
    every = segmentations.sample_batch(m, [text], np.array([1]), len(paths) + 3)[0]
    assert len({tuple(ids.tolist()) for ids, *_ in every}) == len(every) == len(paths) and all(share == 1.0 for *_, share in every)


def test_samples_do_not_depend_on_their_batch():
    m = segmentations.model(vocabulary("piece_bpe_32k.model"))
    texts = ["some words here", "", "x" * 500, "other words, 日本 here", "some words here"]
    together = segmentations.sample_batch(m, texts, np.arange(5), 4)
    for i, t in enumerate(texts):
        alone = segmentations.sample_batch(m, [t], np.array([i]), 4)[0]
        assert [(x.tolist(), share) for x, _, share in alone] == [(x.tolist(), pytest.approx(share)) for x, _, share in together[i]]
        assert all(m.decode(x) == t for x, *_ in alone)
    keys = [share for *_, share in together[0]]
    assert len(keys) == 4 and all(0 <= x <= 1 for x in keys)


def spread(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé日", k=rng.randrange(1, 12))) for _ in range(n))


def as_lists(found):
    return [[(ids.tolist(), total, share) for ids, total, share in x] for x in found]


def test_words_kept_from_other_batches_change_no_sample(monkeypatch):
    m = segmentations.SubwordModel(vocabulary("piece_bpe_32k.model"))
    texts, seeds = [spread(1, 60), "  odd  spaces ", spread(2, 300), "\x00é▁ ▁"], np.arange(4)
    want = as_lists(segmentations.sample_batch(m, texts, seeds, 4))
    states, steps = m.lattices.states, m.lattices.steps
    assert states == sum(map(len, {w for t in texts for w in m.words(t)}))
    assert as_lists(segmentations.sample_batch(m, texts, seeds, 4)) == want
    assert (m.lattices.states, m.lattices.steps) == (states, steps)  # the same words are not laid out again
    segmentations.sample_batch(m, [spread(3, 500)], np.arange(1), 4)
    assert m.lattices.states > states
    assert as_lists(segmentations.sample_batch(m, texts, seeds, 4)) == want
    monkeypatch.setattr(segmentations, "MOST_STATES", 10)
    assert as_lists(segmentations.sample_batch(m, texts[::-1], seeds[::-1], 4))[::-1] == want
    assert m.lattices.states == states


def test_words_walked_alone_and_together_are_the_same(monkeypatch):
    m = segmentations.SubwordModel(vocabulary("piece_bpe_32k.model"), 0.2)
    texts, seeds = [spread(4, 100), "日x" * 300, "\x00\x01" * 40, "y" * 2000], np.arange(4)
    got = []
    for few in (0, 8, 10**6):
        monkeypatch.setattr(segmentations, "FEW", few)
        got.append(as_lists(segmentations.sample_batch(m, texts, seeds, 4)))
    assert got[0] == got[1] == got[2]


def test_open_nodes_are_looked_at_only_where_they_can_be_taken(monkeypatch):
    m = segmentations.SubwordModel(vocabulary("piece_bpe_32k.model"))
    texts, seeds = [spread(n, n) for n in (1, 2, 3, 10, 40, 200, 6000)], np.arange(7)
    keys, plain = [], segmentations.lowered
    monkeypatch.setattr(segmentations, "lowered", lambda limit, loc, u: keys.append(np.size(u)) or plain(limit, loc, u))
    got = [as_lists(segmentations.sample_batch(m, texts, seeds, k)) for k in (1, 4, 30)]
    few = sum(keys)
    segmentations.sample_batch(m, texts[-1:], seeds[-1:], 4)
    assert sum(keys) - few < 1000  # of 4 walks over 6000 words
    monkeypatch.setattr(segmentations, "HEAD", 10**6)  # every open node of every walk
    assert [as_lists(segmentations.sample_batch(m, texts, seeds, k)) for k in (1, 4, 30)] == got


@pytest.mark.parametrize("local", [0, 20, 10**6])
def test_components(spark, local):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark), "cc", local).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(61)), [100, 101, 102]]
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_segmentations_cover_the_documents(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    got = queries.op9_gumbel_segmentations(spark, sf)
    assert "doc_id" in got.columns
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == docs


def longest(part, words):
    """Plain longest common subsequence."""
    row = [0] * (len(words) + 1)
    for w in part:
        now = [0]
        for k, x in enumerate(words):
            now.append(row[k] + 1 if w == x else max(row[k + 1], now[-1]))
        row = now
    return row[-1]


@pytest.mark.parametrize("name", sorted(licenses.NOTICES))
def test_adjacent_notices_are_places_of_their_own(name):
    notice = licenses.NOTICES[name]
    templates = [licenses.Template.of(name, notice, 0.8)]
    n = len(licenses.words(notice))
    for k in range(1, 6):
        for text in ("\n".join([notice] * k), " x ".join([notice] * k), "so " * 40 + " ".join([notice] * k) + " end" * 40):
            places = licenses.find(text, templates, 0.8)
            assert [p[4] for p in places] == [n] * k, (k, places)
            assert all(licenses.words(text[a:z]) == licenses.words(notice) for _, _, a, z, _ in places)


def test_places_against_a_scan_of_every_window():
    rng = random.Random(6)
    notice = licenses.NOTICES["BSD-3-Clause"]
    own = licenses.words(notice)
    n = len(own)
    templates = [licenses.Template.of("BSD-3-Clause", notice, 0.8)]
    for _ in range(25):
        text, planted = [], 0
        for _ in range(rng.randrange(1, 5)):
            text += [rng.choice(["lorem", "ipsum", "the", "of", *own[:3]]) for _ in range(rng.randrange(0, 30))]
            w = list(own)
            for i in sorted(rng.sample(range(n), int(n * rng.choice([0.0, 0.05, 0.1]))), reverse=True):
                if rng.random() < 0.5:
                    w[i] = "changed"
                else:
                    del w[i]
            text += w
            planted += 1
        places = licenses.find(" ".join(text), templates, 0.8)
        assert len(places) == planted
        # every window of the template's length that covers it meets a place, and every place covers it
        spots = [(len(" ".join(text)[:a].split()), len(" ".join(text)[:z].split())) for _, _, a, z, _ in places]
        assert all(longest(text[a:z], own) >= 0.8 * n for a, z in spots)
        for i in range(0, len(text) - n + 1, 3):
            if longest(text[i : i + n], own) >= 0.8 * n:
                assert any(a < i + n and i < z for a, z in spots)


def test_likeness_falls_smoothly_at_every_length():
    for letter in ("q", "é"):
        for n in range(3, 120):
            base = "".join(chr(97 + i * 7 % 26) for i in range(n))
            a, b, c = (merkle.written(merkle.tree(t), merkle.sketches([t])[0]) for t in (base, base[: n // 2] + letter + base[n // 2 + 1 :], base + letter))
            assert merkle.likeness(a, b) >= (n - 6) / (n + 18) > 0 or n < 7
            assert merkle.likeness(a, c) > 0 and merkle.likeness(a, a) == 1.0
