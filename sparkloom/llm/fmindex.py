"""Substring deduplication over words with a compressed FM-index per shard.

A shard's index is the Burrows-Wheeler transform of its segments in a wavelet matrix.
Documents' segments are streamed against it: backward search, one symbol a step for all
segments at once, gives matching statistics (how long a match starts at each word, up to the
window). Where the match spans a window, the suffix interval's least document decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .packed import joined, pack
from .repeats import NEAR, Collector, Found, Layout, Ranges, Unit, remove, repeated_ranges
from .textvec import U64, prefix_sums, span_hash

SHARD = 400_000  # words in one index
WINDOW = 50
GRAM = 8


class WaveletMatrix:
    """Counts of a symbol before a position, from one packed bit vector per bit of the symbols."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.size = len(values)
        self.bits = max(1, int(top).bit_length())
        for k in range(self.bits - 1, -1, -1):
            bit = (values >> k) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = int(len(values) - bit.sum())
            self.levels.append((packed, before, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    @staticmethod
    def ones(level: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start = np.zeros(len(at), np.int64)
        stop = at.astype(np.int64)
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            a, b = self.ones(level, start), self.ones(level, stop)
            start = np.where(one, level[2] + a, start - a)
            stop = np.where(one, level[2] + b, stop - b)
        return stop - start


class FMIndex:
    """An index over texts of 64-bit symbols, each with the document it stands for.

    Suffixes are sorted by their first 2 * window symbols at least, which backward search
    for matches up to one symbol more than the window needs.
    """

    def __init__(self, texts: list[np.ndarray], docs: np.ndarray, window: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.vocabulary, codes = np.unique(np.concatenate(texts), return_inverse=True)
        total = int(lengths.sum()) + len(texts)
        text = np.zeros(total, np.int64)  # 0 ends each text
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lengths)] = codes + 1
        rank, span, at_window = text, 1, None
        order = np.argsort(rank, kind="stable")
        while span < 2 * window:
            if span * 2 > window and at_window is None:
                at_window = (rank, span)
            after = np.zeros(total, np.int64)
            after[:-span] = rank[span:] + 1
            pair = rank * (total + 2) + after
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
            rank = np.empty(total, np.int64)
            rank[order] = new
            span *= 2
        self.window = window
        half, width = at_window if at_window else (text, 1)
        ahead = np.minimum(order + window - width, total - 1)
        same = (half[order][1:] == half[order][:-1]) & (half[ahead][1:] == half[ahead][:-1])
        self.group = np.concatenate([[0], np.cumsum(~same)])  # suffixes with equal first window symbols
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        self.first = np.append(first, total)
        self.least = np.minimum.reduceat(docs[owner[order]], first)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        self.wavelet = WaveletMatrix(text[order - 1], len(self.vocabulary))
        self.total = total

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Symbols' codes in this index; -1 for those it doesn't hold."""
        at = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == values, at + 1, -1)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of symbol + match, given those of the match; empty where there are none."""
        known = np.maximum(symbol, 0)
        r = self.wavelet.rank(np.concatenate([known, known]), np.concatenate([lo, hi]))
        base = self.before[known]
        a, b = base + r[: len(lo)], base + r[len(lo) :]
        return np.where(symbol < 0, 0, a), np.where(symbol < 0, 0, b)

    def matching_statistics(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of the texts, concatenated: the longest match that starts there, up to
        the window, and, where it spans the window, the least document (else -1).
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        symbols = self.codes(np.concatenate(texts))
        begin = np.cumsum(lengths) - lengths
        length, least = np.zeros(len(symbols), np.int64), np.full(len(symbols), -1, np.int64)
        live = np.flatnonzero(lengths)
        at, end = (begin + lengths - 1)[live], (begin + lengths)[live]
        floor = begin[live]
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.total, np.int64)
        while len(at):
            a, b = self.extend(symbols[at], lo, hi)
            ok = a < b
            # a match one longer than the window gives way to its first window symbols
            over = ok & (end - at > self.window)
            end = np.where(over, at + self.window, end)
            g = self.group[np.minimum(a, self.total - 1)]
            a, b = np.where(over, self.first[g], a), np.where(over, self.first[g + 1], b)
            length[at[ok]] = np.maximum(length[at[ok]], (end - at)[ok])
            whole = ok & (end - at == self.window)
            least[at[whole]] = self.least[g[whole]]
            # without a match, try again with an end one symbol earlier; a symbol alone is given up
            alone = ~ok & (end - at == 1)
            end = np.where(ok, end, np.where(alone, at, end - 1))
            at = np.where(ok | alone, at - 1, end - 1)
            lo, hi = np.where(ok, a, 0), np.where(ok, b, self.total)
            left = at >= floor
            at, end, floor, lo, hi = at[left], end[left], floor[left], lo[left], hi[left]
        return length, least


class WordRuns(Collector):
    """Sends marked segments, as runs of word codes sorted by anchor, to the part that an anchor's key names.

    Of segments that are equal within a run only those of the least document are sent.
    """

    def __init__(self, layout: Layout, unit: Unit):
        self.parts, self.window = layout.parts, unit.window
        self.held: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, found: Found) -> None:
        s = found.segments
        size = s.hi - s.lo + self.window
        stop = np.cumsum(size)
        spots = np.arange(stop[-1] if len(stop) else 0) + np.repeat(s.lo - stop + size, size)
        self.held.append((s.key, span_hash(s.sums, s.lo, s.lo + size), found.id, found.tag, found.lo, size.astype(np.uint16), (s.anchor - s.lo).astype(np.uint16), s.codes[spots]))
        self.many += len(spots)

    def size(self) -> int:
        return self.many // 8

    def flush(self) -> tuple[list[tuple[int, bytes]], Ranges]:
        if not self.many:
            return [], [np.zeros(0, k) for k in (np.int64, np.uint32, np.int32, np.int32)]
        key, content, id_, tag, lo, size, anchor, codes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.many = [], 0
        part = (key % U64(self.parts)).astype(np.int32)
        order = np.lexsort((content, key, part))
        at = (np.cumsum(size.astype(np.int64)) - size)[order]
        key, content, id_, tag, lo, size, anchor, part = (x[order] for x in (key, content, id_, tag, lo, size, anchor, part))
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
        copy = id_ > np.repeat(np.minimum.reduceat(id_, start), np.diff(np.append(start, len(id_))))
        decided = [id_[copy], tag[copy], lo[copy], lo[copy] + size[copy].astype(np.int32) - self.window + 1]
        kept = np.flatnonzero(~copy)
        cuts = [0, *(np.flatnonzero(np.diff(part[kept])) + 1).tolist(), len(kept)]
        runs = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = kept[i:j]
            many = size[own].astype(np.int64)
            stop = np.cumsum(many)
            numbers = pack([key[own], id_[own], tag[own], lo[own], size[own], anchor[own]])
            runs.append((int(part[own[0]]), len(numbers).to_bytes(4, "little") + numbers + codes[np.arange(stop[-1]) + np.repeat(at[own] - stop + many, many)].tobytes()))
        return runs, decided


def shards(key: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Segments' numbers in groups of about SHARD words, those with one key together; and whether one key's alone pass it."""
    order = np.argsort(key, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])), len(key))
    upto = np.concatenate([[0], np.cumsum(size[order])])[edges]
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + SHARD, "right")) - 1)
        yield order[edges[i] : edges[j]], bool(upto[j] - upto[i] > SHARD)
        i = j


def cored(sums: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, window: int, near: int) -> tuple[np.ndarray, ...]:
    """Segments cut by longer cores: windows at ``near`` consecutive distances from the anchor share one of window - near + 1 words.

    Gives, for each piece: the segment it is of, its first window in that, its words, its anchor
    (the core's place), and the core's hash.
    """
    far, close = anchor // near, (anchor - (size - window)) // near  # distances of the first and the last window
    many = far - close + 1
    own = np.repeat(np.arange(len(size)), many)
    core = anchor[own] - near * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(close, many))
    lo, hi = np.maximum(0, core - near + 1), np.minimum(size[own] - window, core)
    return own, lo, hi - lo + window, core - lo, span_hash(sums, begin[own] + core, begin[own] + core + window - near + 1)


def repeated_in_shards(runs: list[bytes], window: int) -> Iterator[Ranges]:
    """id, tag, first, stop of the windows of a part's segments that start in another with a smaller id.

    Segments of about SHARD words are indexed at a time and streamed against their index. The
    segments of one anchor stay together; where they pass SHARD they are cut by longer cores,
    and where one of these passes it, by whole windows, of which the least document's is enough.
    """
    split = [(int.from_bytes(r[:4], "little"), r) for r in runs]
    key, id_, tag, lo, size, anchor = joined([r[4 : 4 + n] for n, r in split], [np.uint64, np.int64, np.uint32, np.int32, np.uint16, np.uint16])
    codes = np.concatenate([np.frombuffer(r, np.uint64, -1, 4 + n) for n, r in split])
    size, anchor = size.astype(np.int64), anchor.astype(np.int64)
    begin = np.cumsum(size) - size

    def answers(ids: np.ndarray, tags: np.ndarray, los: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Ranges:
        texts = [codes[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        length, least = FMIndex(texts, ids, window).matching_statistics(texts)
        owner = np.repeat(np.arange(len(ids)), sizes)
        hit = np.flatnonzero((length >= window) & (least < ids[owner]))
        mine, spot = owner[hit], hit - (np.cumsum(sizes) - sizes)[owner[hit]]
        new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (spot[1:] != spot[:-1] + 1)])[: len(hit)]
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(hit))[: len(start)] - 1
        at = mine[start]
        return [ids[at], tags[at], (los[at] + spot[start]).astype(np.int32), (los[at] + spot[stop] + 1).astype(np.int32)]

    for own, over in shards(key, size):
        if not over:
            yield answers(id_[own], tag[own], lo[own], begin[own], size[own])
            continue
        sums = prefix_sums(np.concatenate([codes[a : a + n] for a, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)]))
        within = np.cumsum(size[own]) - size[own]
        seg, first, n, core, name = cored(sums, within, size[own], anchor[own], window, NEAR)
        for part, still in shards(name, n):
            at = own[seg[part]]
            if not still:
                yield answers(id_[at], tag[at], (lo[at] + first[part]).astype(np.int32), begin[at] + first[part], n[part])
                continue
            one, ahead, _, _, content = cored(sums, within[seg[part]] + first[part], n[part], core[part], window, 1)
            at, spot = at[one], lo[at][one] + first[part][one] + ahead
            order = np.argsort(content, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(content[order]) != 0]))
            least = np.repeat(np.minimum.reduceat(id_[at][order], head), np.diff(np.append(head, len(order))))
            hit = order[id_[at][order] > least]
            yield [id_[at[hit]], tag[at[hit]], spot[hit].astype(np.int32), (spot[hit] + 1).astype(np.int32)]


def unit() -> Unit:
    return Unit("word", WINDOW, GRAM)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): each word gone that an earlier document's window covers.

    A window is 50 consecutive words; it is repeated if its word sequence also starts in a
    document with a smaller doc_id, judged on the input. Null and empty texts have no words.
    Rows with a null id neither remove nor lose anything. Rows that share an id do not remove
    each other's words. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    u = unit()
    ranges, parts = repeated_ranges(rows.where("id is not null and text is not null"), u, lambda layout: WordRuns(layout, u), lambda runs: repeated_in_shards(runs, u.window), scratch)
    scratch.settle()
    out = remove(rows, ranges, parts, u, with_text)
    return out.withColumnsRenamed({"id": "doc_id", "n_symbols": "n_words"}).drop("n_spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with the words removed that earlier documents' windows cover.

    A text that loses words is its kept words joined by one space, and its length follows; a
    text that loses none stays as it is. No row is dropped.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    u = unit()
    some = rows.select("id", "text").where("id is not null and text is not null")
    ranges, parts = repeated_ranges(some, u, lambda layout: WordRuns(layout, u), lambda runs: repeated_in_shards(runs, u.window), scratch)
    scratch.settle()
    out = remove(rows.withColumn("row", F.col("row").dropFields(text_col)), ranges, parts, u, True, True)
    text = {text_col: F.col("kept_text"), length_col: F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"row.{length_col}"))}
    return out.select(*(text.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
