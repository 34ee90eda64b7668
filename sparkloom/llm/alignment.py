"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and how often corpus-wide.

Both tokenizers' tokens are byte spans that cover the same text, so the second one's spans are a
static interval index: sorted starts and sorted ends. Each token of the first one stabs it by
bisection and gets the run of tokens it overlaps. A gap between two tokens that no overlap spans
is a group boundary. All tokens of a group are linked with each other; a batch's links are counted
by (document, id pair), never listed by occurrence corpus-wide.

1. one pass encodes and aligns; a document keeps its distinct pairs with their numbers of links,
   and each chunk of about CHUNK bytes its distinct pairs with their numbers of documents;
2. the chunks' pairs are summed corpus-wide, and the highest count of each first id found;
3. each chunk gets the counts of its pairs back, beside its documents, which add them up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attribution import Encoder
from .common import Scratch, vocabulary
from .packed import pack, unpack

CHUNK = 16 << 20  # bytes of text whose pairs are summed up before they travel
BATCH = 1 << 20  # bytes of text aligned at a time
PART = 1 << 16  # characters of a long text that are encoded at a time
LINKS = 1 << 22  # links counted at a time
#: A space between letters or digits of ASCII is the beginning of a token in both tokenizers.
_CUT = re.compile("[A-Za-z0-9] [A-Za-z0-9]")


def parts(text: str, size: int = PART) -> list[str]:
    """A text as parts that encode independently: cut at single spaces, which both tokenizers put before the next part.

    Where there is no such space after ``size`` characters, a part is as long as it takes to the next one.
    """
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start() + 1])
        at = m.start() + 2
    return [*out, text[at:]] if out else [text]


def letter_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """A tokenizer's ids for texts, each with a space before it, and the bytes of every id."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.size = np.array([len(x) for x in raw], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


def is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1, whose letters, digits and blanks every version of Unicode agrees on."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteTokens(Tokens):
    """A byte-level tokenizer of the tokenizers library; special tokens' strings are plain text.

    ``ranks`` may name the same vocabulary as ranks, which is checked: texts of Latin-1 are then
    encoded by these, with the same ids in a quarter of the time.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        names = {i: name for name, i in self.own.get_vocab(with_added_tokens=True).items()}
        byte = letter_bytes()
        super().__init__([bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)])
        special = {i for i, t in self.own.get_added_tokens_decoder().items() if t.special}
        self.fast = None
        if ranks is not None:
            with open(ranks, "rb") as f:
                given = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if given == {x: i for i, x in enumerate(self.raw) if x and i not in special}:
                self.fast = Encoder(given).encode

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self.slow(texts)
        out = [self.fast(" " + t) if is_latin(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.slow([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)] if texts else []


class PieceTokens(Tokens):
    """A sentencepiece model that adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        super().__init__([bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@cache
def tokenizers(path_a: str, path_b: str, ranks: str | None = None) -> tuple[Tokens, Tokens]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return ByteTokens(path_a, ranks), PieceTokens(path_b)


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from 0, given the ends of both covers of the same bytes."""
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    first = np.searchsorted(b_end, a_start, "right")
    last = np.searchsorted(b_start, a_end, "left") - 1
    n = len(b_end)
    spanned = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1))[: n - 1]  # by the overlaps of one A token
    of_b = np.concatenate([[0], np.cumsum(spanned == 0)])[:n]
    return of_b[first], of_b


def weighted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights (1 each without)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[start], np.diff(np.append(start, len(keys)))
    return keys[start], np.add.reduceat(weights[order], start) if len(start) else np.zeros(0, np.int64)


def linked(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, doc: np.ndarray, wide: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct doc * pairs + a * wide + b of all links, and how many links each stands for; ``doc`` is each group's.

    Groups of more links than LINKS are counted by distinct ids first, so they cost no more than those.
    """
    p, q = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    begin_a, begin_b = np.cumsum(p) - p, np.cumsum(q) - q
    links = p * q
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero(links > LINKS).tolist():
        x, nx = weighted(a[begin_a[g] : begin_a[g] + p[g]])
        y, ny = weighted(b[begin_b[g] : begin_b[g] + q[g]])
        step = max(1, LINKS // len(y))
        for i in range(0, len(x), step):
            found.append((((doc[g] * pairs + x[i : i + step] * wide)[:, None] + y).ravel(), (nx[i : i + step, None] * ny).ravel()))
    plain = np.flatnonzero(links <= LINKS)
    upto = np.cumsum(links[plain])
    at = 0
    while at < len(plain):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, "right")))
        own = plain[at:stop]
        at = stop
        many = p[own]
        tokens = np.arange(many.sum()) + np.repeat(begin_a[own] - np.cumsum(many) + many, many)
        group = np.repeat(own, many)
        times = q[group]
        other = np.arange(times.sum()) + np.repeat(begin_b[group] - np.cumsum(times) + times, times)
        head = doc[group] * pairs + a[tokens] * wide
        found.append(weighted(np.repeat(head, times) + b[other]))
    if len(found) == 1:
        return found[0]
    return weighted(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_DIGITS: list = []


def spelled(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n: int, doc_of_group: np.ndarray, docs: int) -> list[bytes]:
    """For each document ``a1,a2|b1;a3|b2,b3``: its groups' ids in decimal."""
    p, q = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    place_a = np.arange(len(a)) + (np.cumsum(q) - q)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(p)[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    done = np.cumsum(p + q)
    mark[done - q - 1], mark[done - 1] = ord("|"), ord(";")
    if not _DIGITS or len(_DIGITS[1]) <= ids.max():
        text = [str(i).encode() for i in range(max(1 << 16, int(ids.max()) + 1))]
        width = max(map(len, text)) + 1
        _DIGITS[:] = [np.array([list(t.ljust(width)) for t in text], np.uint8), np.array([len(t) for t in text], np.int64)]
    digits, size = _DIGITS[0][ids], _DIGITS[1][ids]
    digits[np.arange(len(ids)), size] = mark
    raw = digits[np.arange(digits.shape[1]) <= size[:, None]].tobytes()
    ends = np.cumsum(size + 1)
    groups_of = np.cumsum(np.bincount(doc_of_group, minlength=docs))
    stop = [0, *(ends[done[groups_of - 1] - 1]).tolist()]
    return [raw[i : j - 1] for i, j in zip(stop[:-1], stop[1:], strict=True)]


_ROW = ["n_a", "n_b", "n_groups", "n_links"]


class Aligner:
    """Encodes and aligns batches of texts with two tokenizers."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.wide = len(b.raw)
        self.pairs = len(a.raw) * self.wide

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both id lists of each text; None where a text is empty or the joined bytes differ from space and text."""
        cut = [parts(t) if t else [] for t in texts]
        flat = [p for c in cut for p in c]
        ids_a, ids_b = self.a.ids(flat), self.b.ids(flat)
        out: list[tuple[list[int], list[int]] | None] = []
        at = 0
        for c in cut:
            a, b, fine = [], [], bool(c)
            for p, x, y in zip(c, ids_a[at : at + len(c)], ids_b[at : at + len(c)], strict=True):
                want = b" " + p.encode("utf-8", "surrogatepass")
                fine = fine and b"".join([self.a.raw[i] for i in x]) == want and b"".join([self.b.raw[i] for i in y]) == want
                a += x
                b += y
            at += len(c)
            out.append((a, b) if fine else None)
        return out

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Columns _ROW and the groups' hashes, a value a text, and (text * pairs + pair, links) of all texts."""
        got = self.encoded(texts)
        own = [i for i, x in enumerate(got) if x is not None]
        cols = {c: np.zeros(len(texts), np.int64) for c in _ROW}
        sha = [""] * len(texts)
        if not own:
            return cols, sha, np.zeros(0, np.int64), np.zeros(0, np.int64)
        many_a, many_b = (np.array([len(got[i][k]) for i in own], np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.array(got[i][k], np.int64) for i in own]) for k in (0, 1))
        group_a, group_b = groups(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]))
        last = group_b[np.cumsum(many_b) - 1] + 1
        per_doc = np.diff(last, prepend=0)
        n = int(last[-1])
        doc = np.repeat(np.array(own), per_doc)
        links = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n)
        for c, v in zip(_ROW, (many_a, many_b, per_doc, np.add.reduceat(links, last - per_doc)), strict=True):
            cols[c][own] = v
        for i, x in zip(own, spelled(a, group_a, b, group_b, n, np.repeat(np.arange(len(own)), per_doc), len(own)), strict=True):
            sha[i] = hashlib.sha256(x).hexdigest()
        return cols, sha, *linked(a, group_a, b, group_b, doc, self.wide, self.pairs)


_NUMBERS = [np.int64, np.int64]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of (id, text) batches of about BATCH characters, with their texts; null is empty."""
    for batch in batches:
        texts = [t or "" for t in batch[1].to_pylist()]
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BATCH or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Tokens of A (byte-level) for space + text and of B (pieces, which add the space) are cut into
    groups where both end. Every A and B token of a group are linked. The count of an id pair is
    the number of rows that hold it linked; a link is best where its pair's count is the highest
    of its A id, ties included. Texts that are null or empty, or whose tokens do not join to the
    bytes of space + text, have zeros and an empty hash. Rows that repeat an id or have none are
    documents of their own; an empty table gives no row; other columns are not read. Texts may be
    of any length. ``ranks`` may name A's vocabulary as ranks (see ByteTokens), as for the public one.
    """
    if path_a is None:
        path_a, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    path_b = path_b or vocabulary("piece_bpe_32k.model")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    told = [f"{c} long" for c in _ROW]
    schema = f"chunk long, is_doc boolean, doc_id {kind}, {', '.join(told)}, groups_sha256 string, pairs binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*tokenizers(path_a, path_b, ranks))
        chunk = TaskContext.get().partitionId() << 24
        names = ["chunk", "is_doc", "doc_id", *_ROW, "groups_sha256", "pairs"]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        id_type = None

        def summed() -> pa.RecordBatch:
            pair, n = weighted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            none = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([False]), *none, pa.array([pack([pair, n])], pa.binary())], names=names)

        for batch, texts in _bounded(batches):
            id_type = batch[0].type
            cols, sha, key, links = aligner.align(texts)
            doc, pair = np.divmod(key, aligner.pairs)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            packs = [pack([pair[i:j], links[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), chunk)), pa.array(np.ones(len(texts), bool)), batch[0], *(pa.array(cols[c]) for c in _ROW), pa.array(sha, pa.string()), pa.array(packs, pa.binary())], names=names)
            if len(pair):
                held.append(weighted(pair))
            size += sum(map(len, texts))
            if size >= CHUNK:
                if held:
                    yield summed()
                chunk, size = chunk + 1, 0
            elif len(held) > 16:
                held[:] = [weighted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            yield summed()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                pair, n = unpack(raw, _NUMBERS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(n)], names=["chunk", "pair", "n"])

    wide = F.lit(len(tokenizers(path_a, path_b, ranks)[1].raw))
    made = scratch.keep(rows.mapInArrow(encode, schema), "aligned")
    chunks = made.where("not is_doc").select("chunk", "pairs").mapInArrow(listed, "chunk long, pair long, n long")
    counts = chunks.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / wide))
    counts = scratch.keep(counts, "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    # no more rows than A has ids
    counts = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = chunks.select("chunk", "pair").join(counts, "pair")
    docs_too = made.where("is_doc").select("chunk", *(F.lit(None).cast(t).alias(c) for c, t in (("pair", "long"), ("n", "long"), ("best", "boolean"))), "doc_id", *_ROW, "groups_sha256", "pairs")
    both = docs_too.unionByName(back, allowMissingColumns=True)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, known = None, [], None
        for batch in batches:
            ids, is_doc = batch["chunk"].to_numpy(), batch["pairs"].is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if j == i:
                    continue
                if ids[i] != chunk:
                    chunk, held, known = ids[i], [], None
                part = batch.slice(i, j - i)
                if not is_doc[i]:
                    held.append((part["pair"].to_numpy(), part["n"].to_numpy(), part["best"].to_numpy(zero_copy_only=False)))
                    continue
                if known is None:
                    known = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, t) for t in (np.int64, np.int64, bool)]
                best, total = [], []
                for raw in part["pairs"].to_pylist():
                    pair, links = unpack(raw, _NUMBERS)
                    at = np.searchsorted(known[0], pair)
                    best.append(int(links[known[2][at]].sum()))
                    total.append(int((links * known[1][at]).sum()))
                columns = {"doc_id": part["doc_id"]} | {c: part[c] for c in _ROW} | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": part["groups_sha256"]}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = f"doc_id {kind}, {', '.join(told)}, n_best long, count_sum long, groups_sha256 string"
    return both.repartition("chunk").sortWithinPartitions("chunk", F.col("pairs").isNotNull(), "pair").mapInArrow(add_up, out)
