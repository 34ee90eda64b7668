"""Cross-tokenizer alignment against a brute-force version on small documents."""

import collections
import hashlib
import random

import numpy as np

from sparkloom.llm import alignment
from sparkloom.llm.common import vocabulary

PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def brute(rows):
    """The contract, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(vocabulary(PATHS[0]))
    ta.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=vocabulary(PATHS[1]))
    byte = alignment.letter_bytes()
    docs = []
    for _, t in rows:
        want = (" " + t).encode() if t else b""
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        raw_a = [bytes(byte[c] for c in ta.id_to_token(i)) for i in a]
        pieces = [sp.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, at = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if at < e <= cut], [i for i, e in zip(b, ends_b) if at < e <= cut]))
            at = cut
        docs.append((a, b, groups, [(x, y) for p, q in groups for x in p for y in q]))
    count = collections.Counter(p for d in docs for p in set(d[3]))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, docs):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(5)
    bits = ["the ", "Ärger ", "日本", "🙂", " \n", "  ", "\t", "x1y2", "<|endoftext|>", "<s>", "<0x41>", "thndion ", "naïve", "▁", "ﬁ", "'s", " ", "é", "a" * 40, "　"]
    out = [None, "", " ", "a", " a", "a  b", "▁", "hello▁x", "<|endoftext|>", "\x00", "a b " * 3000, "b" * 5000, " " * 3000]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(80)] + ["the same"] * 5


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows], "doc_id long, text string, n_a long, pairs string, best boolean")


def test_against_brute_force_in_any_layout(spark, monkeypatch):
    rows = [(i * 7, t) for i, t in enumerate(texts())] + [(None, "the same"), (7, "a"), (7, "another the same")]
    want = sorted(brute(rows), key=repr)
    assert any(r[1] == 0 and dict((i, t) for i, t in rows)[r[0]] for r in want)  # some text does not come back
    assert rows_of(alignment.aligned(frame(spark, rows).repartition(3))) == want
    for name, value in (("CHUNK", 400), ("BATCH", 100), ("PART", 30), ("LINKS", 5)):
        monkeypatch.setattr(alignment, name, value)
    assert rows_of(alignment.aligned(frame(spark, rows).coalesce(1))) == want
    assert rows_of(alignment.aligned(frame(spark, []))) == []


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    ga, gb = np.sort(rng.integers(0, 4, 300)), np.sort(rng.integers(0, 4, 200))
    doc = np.array([0, 0, 1, 2])
    want = collections.Counter(int(doc[g] * 63 + x * 7 + y) for x, g in zip(a, ga) for y, h in zip(b, gb) if g == h)
    for most in (1, 1000, 1 << 22):
        monkeypatch.setattr(alignment, "LINKS", most)
        key, links = alignment.linked(a, ga, b, gb, doc, 7, 63)
        assert dict(zip(key.tolist(), links.tolist(), strict=True)) == want


def test_long_texts_are_cut_where_both_encode_alike():
    a, b = alignment.tokenizers(*map(vocabulary, PATHS), vocabulary("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " x", "  ", "\n", " é", "9 ", "日", " A"]) for _ in range(6000))
    cut = alignment.parts(text, 50)
    assert len(cut) > 20 and " ".join(cut) == text
    for t in (a, b):
        assert [i for ids in t.ids(cut) for i in ids] == t.ids([text])[0]


def test_ranks_give_the_same_ids():
    slow, fast = (alignment.ByteTokens(vocabulary(PATHS[0]), r) for r in (None, vocabulary("byte_bpe_50k.tiktoken")))
    assert slow.fast is None and fast.fast is not None
    rng = random.Random(3)
    every = [chr(i) for i in range(256)]
    mixed = [" ", "a", "the", "\n", "'s", "1", "<|endoftext|>", "日", "œ"]
    some = ["".join(rng.choice(every) for _ in range(80)) for _ in range(300)] + ["".join(rng.choice(mixed) for _ in range(40)) for _ in range(300)]
    some += [t for t in texts() if t] + [a + b for a in every for b in ("a", " ", "1", "\n")]
    assert fast.ids(some) == slow.ids(some)
