"""Substring deduplication over bytes by merging sorted suffix runs.

Map tasks sort the suffixes that begin at their segments' anchors, cut the order at splitters
drawn from a sample, and send each range as a front-coded run: an entry is the length it shares
with the one before and the bytes that follow. The task of a range combines its runs with a
loser tree whose entries remember what they share with the last one sent up, so bytes known to
be equal are never compared again. The ranges are in order, so together they are one sorted
order of all the suffixes; its common-prefix lengths tell which windows several segments share.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .packed import pack, unpack
from .repeats import NEAR, Collector, Found, Layout, Ranges, Unit, remove, repeated_ranges
from .textvec import U64

WINDOW = 50
GRAM = 20


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of two strings that share ``known`` bytes already."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    for i in range(known, n):
        if a[i] != b[i]:
            return i
    return n


def front_code(items: list[bytes]) -> bytes:
    """Sorted strings (of under 256 bytes), each as (shared with the one before, length of the rest, rest)."""
    out, last = [], b""
    for x in items:
        k = shared(last, x)
        out.append(bytes((k, len(x) - k)) + x[k:])
        last = x
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with what it shares with the one before."""
    last, at = b"", 0
    while at < len(run):
        k, n = run[at], run[at + 1]
        at += 2
        last = last[:k] + run[at : at + n]
        at += n
        yield last, k


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(run, shared prefix with the entry before) in the order of the merged strings; of equal ones the earlier run first.

    A loser tree over the runs' heads. Each head's ``lcp`` is what it shares with the string
    sent up last, or, for a loser, with the winner that beat it; on the path of a winner's
    replacement both refer to the same string. Of two heads the one with the longer such
    prefix is the smaller; only with equal ones are bytes compared, from there on.
    """
    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    head: list[bytes | None] = [None] * size
    lcp = [-1] * size  # -1: the run is at its end
    for i, r in enumerate(runs):
        got = next(r, None)
        if got is not None:
            head[i], lcp[i] = got[0], 0
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's lcp then is with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        h = shared(x, y, lcp[a])
        first = a < b if h == len(x) == len(y) else h == len(x) or (h < len(y) and x[h] < y[h])
        w, lose = (a, b) if first else (b, a)
        lcp[lose] = h
        return w, lose

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return w

    top = build(1) if size > 1 else 0
    while head[top] is not None:
        yield top, lcp[top]
        got = next(runs[top], None)
        head[top], lcp[top] = got if got is not None else (None, -1)
        node = (top + size) >> 1
        while node:
            other = loser[node]
            if lcp[other] == lcp[top]:
                top, loser[node] = play(top, other)
            elif lcp[other] > lcp[top]:
                top, loser[node] = other, top
            node >>= 1


AHEAD, BEHIND = WINDOW, WINDOW - GRAM  # bytes from the anchor on, and before it, that a segment can have
_ROW = AHEAD + 1 + BEHIND + 1
_NUMBERS = [np.int64, np.uint32, np.int32, np.uint8, np.uint8, np.uint8]  # id, tag, first window, bytes from and before the anchor, shared


class SuffixRuns(Collector):
    """Makes front-coded runs of the suffixes that begin at segments' anchors, sorted and dealt to ranges of that order.

    Every segment is a row of fixed width: its suffix from the anchor, filled up, the suffix'
    length, the bytes before the anchor from the nearest on, filled up, and their number. Rows
    that are equal are segments that are equal.
    """

    def __init__(self, layout: Layout, unit: Unit):
        self.layout, self.window = layout, unit.window
        # as many ranges as tasks; where there are more parts, the anchors of a range are dealt to several by their hash
        self.tasks = layout.tasks
        self.each = -(-layout.parts // self.tasks)
        spots = np.linspace(0, len(layout.sample), self.tasks + 1)[1:-1].astype(int)
        self.splitters = layout.sample[np.minimum(spots, len(layout.sample) - 1)] if len(layout.sample) else layout.sample
        self.held: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, found: Found) -> None:
        s, data = found.segments, found.data
        ahead, behind = s.hi + self.window - s.anchor, s.anchor - s.lo
        rows = np.zeros((len(s.lo), _ROW), np.uint8)
        for at, count, step, size in ((0, AHEAD, 1, ahead), (AHEAD + 1, BEHIND, -1, behind)):
            if len(data):
                spots = s.anchor[:, None] + (step * np.arange(count) - (step < 0))
                rows[:, at : at + count] = np.where(np.arange(count) < size[:, None], data[np.clip(spots, 0, len(data) - 1)], 0)
            rows[:, at + count] = size
        self.held.append((rows, found.id, found.tag, found.lo, s.fine, (s.key >> U64(40)).astype(np.uint32)))
        self.many += len(rows)

    def size(self) -> int:
        return self.many

    def flush(self) -> tuple[list[tuple[int, bytes]], Ranges]:
        if not self.many:
            return [], [np.zeros(0, k) for k in (np.int64, np.uint32, np.int32, np.int32)]
        rows, id_, tag, lo, fine, spread = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.many = [], 0
        whole = rows.view(f"S{_ROW}").ravel()
        order = np.argsort(whole, kind="stable")
        rows, id_, tag, lo, fine, spread, whole = (x[order] for x in (rows, id_, tag, lo, fine, spread, whole))
        start = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        copy = id_ > np.repeat(np.minimum.reduceat(id_, start), np.diff(np.append(start, len(id_))))
        decided = whole_ranges(rows, id_, tag, lo, copy, self.window)
        kept = np.flatnonzero(~copy)
        rows, id_, tag, lo = rows[kept], id_[kept], tag[kept], lo[kept]
        part = self.parts_of(rows, fine[kept]) + self.tasks * (spread[kept] % self.each).astype(np.int32)
        turn = np.argsort(part, kind="stable")  # ranges ascend already but for refined anchors
        cuts = [0, *(np.flatnonzero(np.diff(part[turn])) + 1).tolist(), len(turn)]
        return [(int(part[turn[i]]), front_coded(*(x[turn[i:j]] for x in (rows, id_, tag, lo)))) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], decided

    def parts_of(self, rows: np.ndarray, fine: np.ndarray) -> np.ndarray:
        """The range of each suffix. Suffixes with equal grams stay together; those of refined anchors are
        told apart by their whole cores, so a hot anchor spreads over the ranges that the sample gives it.
        """
        if not len(self.splitters):
            return np.zeros(len(rows), np.int32)

        def place(n: int, own: np.ndarray) -> np.ndarray:
            return np.searchsorted(self.splitters.astype(f"S{n}"), np.ascontiguousarray(rows[own, :n]).view(f"S{n}").ravel(), "right")

        out = np.zeros(len(rows), np.int32)
        for n, own in ((GRAM, np.flatnonzero(~fine)), (WINDOW - NEAR + 1, np.flatnonzero(fine))):
            if len(own):
                out[own] = place(n, own)
        return out


def whole_ranges(rows: np.ndarray, ids: np.ndarray, tags: np.ndarray, los: np.ndarray, own: np.ndarray, window: int) -> Ranges:
    """All windows of some segments as ranges."""
    many = rows[own, AHEAD].astype(np.int32) + rows[own, _ROW - 1] - window + 1
    return [ids[own], tags[own], los[own], los[own] + many]


def common(rows: np.ndarray, at: int, width: int, sizes: np.ndarray) -> np.ndarray:
    """What each row shares with the one before in ``width`` bytes from ``at`` on; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:, at : at + width] != rows[:-1, at : at + width]
        n = np.where(differ.any(1), differ.argmax(1), width)
        out[1:] = np.minimum(n, np.minimum(sizes[1:], sizes[:-1]))
    return out


def front_coded(rows: np.ndarray, ids: np.ndarray, tags: np.ndarray, los: np.ndarray) -> bytes:
    """A sorted run: its numbers, of each suffix the bytes that it doesn't share with the one before, and the bytes before the anchors."""
    ahead, behind = rows[:, AHEAD], rows[:, _ROW - 1]
    known = common(rows, 0, AHEAD, ahead)
    spot = np.arange(AHEAD)
    rest = rows[:, :AHEAD][(spot >= known[:, None]) & (spot < ahead[:, None])]
    before = rows[:, AHEAD + 1 : _ROW - 1][np.arange(BEHIND) < behind[:, None]]
    numbers = pack([ids, tags, los, ahead, behind, known.astype(np.uint8)])
    return _HEAD.pack(len(numbers), len(rest)) + numbers + rest.tobytes() + before.tobytes()


_HEAD = struct.Struct("<II")


def read_run(data: bytes) -> tuple[list[np.ndarray], bytes, np.ndarray]:
    """A run's numbers, its suffixes' bytes, and the bytes before its anchors."""
    a, b = _HEAD.unpack_from(data)
    at = _HEAD.size
    return unpack(data[at : at + a], _NUMBERS), data[at + a : at + a + b], np.frombuffer(data, np.uint8, -1, at + a + b)


def suffixes(numbers: list[np.ndarray], rest: bytes) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a run, each with what it shares with the one before."""
    last, at = b"", 0
    for n, k in zip(numbers[3].tolist(), numbers[5].tolist(), strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield last, k


def repeated_in_runs(runs: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Iterator[Ranges]:
    """id, tag, first, stop of the windows of a part's segments that start in another with a smaller id.

    The runs' suffixes are merged, which gives their order and common prefixes; the bytes before
    the anchors are ordered beside. A window ``o`` bytes ahead of the anchor is the same in two
    segments if their suffixes share window - o bytes and what lies before them o. Both orders'
    common prefixes cut the segments into classes; the least id of a window's class decides.
    Segments that are equal as a whole are decided first, and one document's stand for them.
    """
    got = [read_run(r) for r in runs]
    base = np.cumsum([0, *(len(numbers[0]) for numbers, _, _ in got)])
    n = int(base[-1])
    ids, tags, los, ahead, before, _ = (np.concatenate(x) for x in zip(*(numbers for numbers, _, _ in got), strict=True))
    ahead, before = ahead.astype(np.int64), before.astype(np.int64)
    merged = np.fromiter(merge([suffixes(numbers, rest) for numbers, rest, _ in got]), np.dtype((np.int64, 2)), n)
    lcp = merged[:, 1].copy()
    turn = np.empty(n, np.int64)
    turn[np.argsort(merged[:, 0], kind="stable")] = np.arange(n)  # the entries of a run come out in its own order
    back = np.zeros((n, BEHIND + 1), np.uint8)
    back[:, :BEHIND][np.arange(BEHIND) < before[:, None]] = np.concatenate([x for _, _, x in got])
    back[:, BEHIND] = before
    ids, tags, los, ahead, before, back = (x[turn] for x in (ids, tags, los, ahead, before, back))

    def left_order(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of what lies before some anchors, and the common prefixes in it."""
        order = np.argsort(back[own].view(f"S{BEHIND + 1}").ravel(), kind="stable")
        return order, common(back[own[order]], 0, BEHIND, np.full(len(own), BEHIND))

    group = np.cumsum(lcp < gram)  # suffixes that share a gram
    rank, shared_left = left_order(np.arange(n))
    left = np.empty(n, np.int64)
    left[rank] = np.cumsum((shared_left < BEHIND) | (np.diff(before[rank], prepend=-1) != 0))
    right = np.cumsum(lcp < np.maximum(ahead, np.concatenate([[0], ahead[:-1]])))
    kind = np.unique(right * (n + 1) + left, return_inverse=True)[1]
    least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    copy = ids > least[kind]
    many = (ahead + before - window + 1).astype(np.int32)
    yield [ids[copy], tags[copy], los[copy], los[copy] + many[copy]]

    # only where a gram has segments of different content is there more to find
    kept = ~copy
    kinds = np.zeros(n + 1, np.int64)
    firsts = np.unique(kind[kept], return_index=True)[1]
    np.add.at(kinds, group[kept][firsts], 1)
    own_all = np.flatnonzero(kept & (kinds[group] > 1))
    if len(own_all) < 2:
        return
    # prefixes shared with the entry before among those left: the least in between
    lcp = np.minimum.reduceat(np.append(lcp, 0), np.stack([np.concatenate([[0], own_all[:-1] + 1]), own_all + 1], 1).ravel())[::2]
    lcp[0] = 0
    rank, shared_left = left_order(own_all)
    id_, before, ahead = ids[own_all], before[own_all], ahead[own_all]
    m = len(own_all)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    cls_l = np.empty(m, np.int64)
    for o in range(window - gram + 1):
        own = np.flatnonzero((window - ahead <= o) & (o <= before))
        if len(own) < 2:
            continue
        cls_r = np.cumsum(lcp < window - o)
        cls_l[rank] = np.cumsum(shared_left < o)
        code = cls_r[own] * (m + 1) + cls_l[own]
        turn = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], code[turn][1:] != code[turn][:-1]]))
        less = np.repeat(np.minimum.reduceat(id_[own][turn], first), np.diff(np.append(first, len(own)))) < id_[own][turn]
        hit = own[turn][less]
        hits.append((hit, before[hit] - o))
    own, spot = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    turn = np.lexsort((spot, own))
    own, spot = own[turn], spot[turn]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (spot[1:] != spot[:-1] + 1)])[: len(own)]
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(own))[: len(a)] - 1
    at = own_all[own[a]]
    yield [ids[at], tags[at], (los[at] + spot[a]).astype(np.int32), (los[at] + spot[z] + 1).astype(np.int32)]


def unit() -> Unit:
    return Unit("byte", WINDOW, GRAM)


def byte_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each UTF-8 byte gone that an earlier document's 50-byte string covers.

    A null text is empty. Strings are judged on the input and never cross documents. Rows with
    a null id neither remove nor lose anything; rows that share an id do not remove each
    other's bytes. An empty table gives an empty result. The text kept, if asked for, replaces
    what a cut through a character leaves.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    u = unit()
    ranges, parts = repeated_ranges(rows.where("id is not null and text is not null"), u, lambda layout: SuffixRuns(layout, u), lambda runs: repeated_in_runs(runs, u.window, u.gram), scratch)
    scratch.settle()
    out = remove(rows, ranges, parts, u, with_text)
    return out.withColumnsRenamed({"id": "doc_id", "n_symbols": "n_bytes"})
