"""Finding text windows that already start in an earlier document, for words or for bytes.

Shared by the two substring deduplicators. Every window of a document belongs to an anchor,
the least gram in it; equal windows have equal anchors at the same place. Consecutive windows
with one anchor form a segment. Four jobs over tables, the same at every size:

1. ``shared_marks``: anchors that occur in one document only cannot hold a repeated window;
   the segments of the others are marked in their documents;
2. ``repeated_ranges`` sends the marked segments' contents as sorted runs to an engine's parts;
   of segments that are equal within a run only those of the least document go on, the others
   are repeats already;
3. the engine finds which windows of its segments start in another one with a smaller
   document. The engine is what the two deduplicators differ in: an FM-index over words, or
   merged sorted suffix runs over bytes;
4. ``remove`` lays the windows found over the documents and takes out what they cover.

An anchor so frequent that it would fill parts of its own (a common line in ever new
surroundings) is refined: its windows at NEAR consecutive distances share a longer core, which
takes the anchor's place. What is equal stays together, what is not spreads over all parts.

Parts follow the bytes of text without limit. A shuffle has MOST_TASKS tasks at most; beyond, a
task takes the parts that are its share one after the other, and senders have a row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch
from .packed import PACKS, beside, bundle_schema, bundled, dealt, gathered, joined, part_of, parts_for, tasks_for
from .textvec import _BYTE, IS_SPACE, U64, anchored, chunks, prefix_sums, span_hash, words

NEAR = 8
FLUSH = 1 << 20  # segments that a map task holds before it sends them
LEAST_HOT = 2000  # segments an anchor has at least before it counts as hot
HOT_SHARE = 128  # and a segment for so many bytes of a part
SAMPLES = 16  # anchors' contents sampled for each task
_SEED = U64(0x3C6EF372FE94F82A)

Symbols = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Unit:
    """What the symbols of a document are. ``symbols`` gives their codes, their byte spans and each document's first."""

    def __init__(self, name: str, window: int, gram: int):
        self.name, self.window, self.gram = name, window, gram

    def symbols(self, data: np.ndarray, off: np.ndarray) -> Symbols:
        if self.name == "word":
            return words(data, off)
        at = np.arange(len(data))
        return _BYTE[data], at, at + 1, off

    def kept(self, data: np.ndarray, off: np.ndarray, symbols: Symbols, gone: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of the symbols that are not gone, words of a document joined by one space, and each document's first."""
        _, starts, stops, bounds = symbols
        if self.name == "byte":
            return data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[bounds].tolist()
        own = np.flatnonzero(~gone)
        doc = np.searchsorted(bounds, own, "right")
        more = np.concatenate([doc[1:] == doc[:-1], [False]])[: len(own)]  # then the byte that follows is a separator
        edge = np.bincount(starts[own], minlength=len(data) + 1) - np.bincount(stops[own] + more, minlength=len(data) + 1)
        kept = np.cumsum(edge[:-1]) > 0
        return np.where(IS_SPACE[data], np.uint8(0x20), data)[kept].tobytes(), np.concatenate([[0], np.cumsum(kept)])[off].tolist()


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols))


@dataclass
class Segments:
    """Segments of a chunk of documents: windows lo..hi around an anchor, all as symbol numbers in the chunk."""

    codes: np.ndarray
    bounds: np.ndarray  # where each document's symbols begin
    sums: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    fine: np.ndarray  # whether the anchor is a core of a refined one

    def take(self, own: np.ndarray) -> Segments:
        return Segments(self.codes, self.bounds, self.sums, *(x[own] for x in (self.lo, self.hi, self.anchor, self.doc, self.key, self.fine)))


def cut(unit: Unit, data: np.ndarray, off: np.ndarray) -> Segments | None:
    codes, _, _, bounds = unit.symbols(data, off)
    lo, hi, anchor, sums = anchored(codes, bounds, unit.window, unit.gram)
    if not len(lo):
        return None
    doc = np.searchsorted(bounds, lo, "right") - 1
    return Segments(codes, bounds, sums, lo, hi, anchor, doc, span_hash(sums, anchor, anchor + unit.gram), np.zeros(len(lo), bool))


def refined(s: Segments, unit: Unit, hot: np.ndarray) -> Segments:
    """The segments with those of hot anchors cut anew: windows at NEAR consecutive distances from the anchor share a core."""
    is_hot = np.isin(s.key, hot)
    if not is_hot.any():
        return s
    own = np.flatnonzero(is_hot)
    far, near = (s.anchor[own] - s.lo[own]) // NEAR, (s.anchor[own] - s.hi[own]) // NEAR
    many = far - near + 1
    own = np.repeat(own, many)
    core = s.anchor[own] - NEAR * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(near, many))
    lo, hi = np.maximum(s.lo[own], core - NEAR + 1), np.minimum(s.hi[own], core)
    key = span_hash(s.sums, core, core + unit.window - NEAR + 1) ^ _SEED
    rest = s.take(np.flatnonzero(~is_hot))
    both = [np.concatenate(x) for x in ((rest.lo, lo), (rest.hi, hi), (rest.anchor, core), (rest.doc, s.doc[own]), (rest.key, key), (rest.fine, np.ones(len(own), bool)))]
    return Segments(s.codes, s.bounds, s.sums, *both)


def text_tags(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each document's symbols, which tells rows apart that repeat an id."""
    return (span_hash(sums, bounds[:-1], bounds[1:]) >> U64(32)).astype(np.uint32)


@dataclass
class Layout:
    """Into how many parts things are dealt, and what the first pass found out about the anchors."""

    parts: int
    tasks: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    sample: np.ndarray = field(default_factory=lambda: np.zeros(0, "S43"))


_MARK = [np.int64, np.int32]
_SENT = [np.uint64, np.int64, np.int32, np.uint32]
_HOT, _SAMPLE, _KEYS = -3, -2, -1
_SEND = ["bucket", "part", "data"]


def exchanged(sent: DataFrame, tasks: int) -> DataFrame:
    """bucket, part, data: what was sent to each bucket, a bucket's rows together."""
    return sent.repartitionById(tasks, F.col("task")).select(F.inline("items")).sortWithinPartitions("bucket")


def shared_marks(docs: DataFrame, unit: Unit, scratch: Scratch) -> tuple[DataFrame, Layout]:
    """Bundles of packs of (id, first window in its document) of the segments whose anchors another document has too.

    A task sends each key of a flush once, with its least and its greatest document; where these
    differ, its other segments are marked at once. So a frequent anchor costs a part two entries a flush.
    """
    parts, total = parts_for(docs, "text")
    tasks = tasks_for(parts)
    per_part = total // parts
    limit = max(LEAST_HOT, per_part // HOT_SHARE)
    rate = min(1.0, SAMPLES * tasks * 16 / max(1, total)) if unit.name == "byte" else 0.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        sample: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, id_, lo = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, id_, lo = key[order], id_[order], lo[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.diff(np.append(start, len(key)))
            least, most = np.minimum.reduceat(id_, start), np.maximum.reduceat(id_, start)
            group = np.repeat(np.arange(len(start)), many)
            several = (least < most)[group]
            sent = ~several
            for end in (least, most):
                at = np.flatnonzero(several & (id_ == end[group]))
                sent[at[np.concatenate([[True], group[at][1:] != group[at][:-1]])[: len(at)]]] = True
            count = np.zeros(len(key), np.uint32)
            count[start] = many
            sent[start] |= count[start] > 1  # someone has to carry the count
            rows = [(b, _KEYS, x) for b, x in dealt((key[sent] % U64(parts)).astype(np.int32), [key[sent], id_[sent], lo[sent], count[sent]])]
            mine = several & ~sent
            rows += [(p, p, x) for p, x in dealt(part_of(id_[mine], parts), [id_[mine], lo[mine]])]
            if sample:
                rows.append((0, _SAMPLE, b"".join(sample)))
                sample.clear()
            yield bundled(rows, _SEND, tasks)

        size = 0
        for batch in batches:
            ids = batch[0].to_numpy(zero_copy_only=False)
            for rows, off, data in chunks(batch[0], batch[1], 1 << 18):
                if (s := cut(unit, data, off)) is None:
                    continue
                id_, lo = ids[rows[s.doc]], (s.lo - s.bounds[s.doc]).astype(np.int32)
                held.append((s.key, id_, lo))
                if rate:
                    drawn = np.flatnonzero(((s.key ^ id_.view(np.uint64)) * U64(0x9E3779B97F4A7C15) >> U64(11)).astype(np.float64) < rate * 2.0**53)
                    stop = s.bounds[s.doc[drawn] + 1]
                    sample.extend(data[a : min(a + 43, z)].tobytes().ljust(43, b"\0") for a, z in zip(s.anchor[drawn].tolist(), stop.tolist(), strict=True))
                size += len(s.key)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in gathered(batches, "bucket"):
            own = [x for p, x in zip(held["part"], held["data"], strict=True) if p == _KEYS]
            rows = [(p, x) for p, x in zip(held["part"], held["data"], strict=True) if p != _KEYS]
            if own:
                key, id_, lo, count = joined(own, _SENT)
                order = np.argsort(key)
                key, id_, lo, count = key[order], id_[order], lo[order], count[order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                several = np.minimum.reduceat(id_, start) < np.maximum.reduceat(id_, start)
                hot = key[start][several & (np.add.reduceat(count.astype(np.int64), start) > limit)]
                mine = np.repeat(several, np.diff(np.append(start, len(key))))
                rows += dealt(part_of(id_[mine], parts), [id_[mine], lo[mine]])
                if len(hot):
                    rows.append((_HOT, hot.tobytes()))
            if rows:
                yield bundled(rows, PACKS, tasks)

    sent = docs.select("id", "text").mapInArrow(scan, bundle_schema(_SEND))
    marks = scratch.keep(exchanged(sent, tasks).mapInArrow(decide, bundle_schema(PACKS)), "marks")
    # hot keys are those that would fill a part, so there are fewer than parts; samples are SAMPLES a task
    told = marks.where(F.col("task") < _KEYS).select(F.inline("items")).collect()
    layout = Layout(parts, tasks)
    layout.hot = np.concatenate([layout.hot, *(np.frombuffer(r["data"], np.uint64) for r in told if r["part"] == _HOT)])
    drawn = b"".join(r["data"] for r in told if r["part"] == _SAMPLE)
    layout.sample = np.sort(np.frombuffer(drawn, "S43"))
    return marks.where("task >= 0"), layout


def _spread(ids: np.ndarray, sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of ``sorted_ids`` equal each of ``ids``: the number among ``ids``, and the entry, one after the other."""
    a, b = np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, "right")
    many = b - a
    owner = np.repeat(np.arange(len(ids)), many)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)


@dataclass
class Found:
    """Marked segments on their way to an engine: their document, a hash of its text, and their first window in it."""

    segments: Segments
    data: np.ndarray
    id: np.ndarray
    tag: np.ndarray
    lo: np.ndarray


class Collector:
    """Gathers marked segments in a task; ``flush`` gives runs for the engine's parts and the ranges decided on the way."""

    def add(self, found: Found) -> None:
        raise NotImplementedError

    def size(self) -> int:
        raise NotImplementedError

    def flush(self) -> tuple[list[tuple[int, bytes]], Ranges]:
        raise NotImplementedError


Ranges = list[np.ndarray]  # id, tag, first, stop
_RANGE = [np.int64, np.uint32, np.int32, np.int32]
Engine = Callable[[list[bytes]], Iterator[Ranges]]


def repeated_ranges(docs: DataFrame, unit: Unit, collector: Callable[[Layout], Collector], engine: Engine, scratch: Scratch) -> tuple[DataFrame, int]:
    """Bundles of packs of (id, tag, first, stop), the ranges of window starts (by symbol number) whose windows also start in a document with a smaller id."""
    marks, layout = shared_marks(docs, unit, scratch)
    scratch.settle()
    parts, tasks = layout.parts, layout.tasks

    def collect(packs: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_m, lo_m = joined(packs, _MARK)
        order = np.argsort(id_m, kind="stable")
        id_m, lo_m = id_m[order], lo_m[order]
        own = collector(layout)

        def flush() -> Iterator[pa.RecordBatch]:
            runs, decided = own.flush()
            rows = [(b, _KEYS, x) for b, x in runs] + [(p, p, x) for p, x in dealt(part_of(decided[0], parts), decided)]
            if rows:
                yield bundled(rows, _SEND, tasks)

        for batch in batches if len(id_m) else ():
            ids = batch["id"].to_numpy(zero_copy_only=False)
            for rows, off, data in chunks(batch["id"], batch["text"], 1 << 18):
                owner, at = _spread(ids[rows], id_m)
                if not len(owner) or (s := cut(unit, data, off)) is None:
                    continue
                wanted = np.zeros(len(s.codes) + 1, bool)
                spot = s.bounds[owner] + lo_m[at]
                wanted[spot[spot < s.bounds[owner + 1]]] = True  # rows that repeat an id share its marks
                s = refined(s.take(np.flatnonzero(wanted[s.lo])), unit, layout.hot)
                own.add(Found(s, data, ids[rows[s.doc]], text_tags(s.sums, s.bounds)[s.doc], (s.lo - s.bounds[s.doc]).astype(np.int32)))
                if own.size() >= FLUSH // 4:
                    yield from flush()
        yield from flush()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in gathered(batches, "bucket"):
            rows = [(p, x) for p, x in zip(held["part"], held["data"], strict=True) if p != _KEYS]
            runs = [x for p, x in zip(held["part"], held["data"], strict=True) if p == _KEYS]
            for ranges in engine(runs) if runs else ():
                rows += dealt(part_of(ranges[0], parts), ranges)
            if rows:
                yield bundled(rows, PACKS, tasks)

    sent = beside(docs.select("id", "text"), marks, parts, collect, bundle_schema(_SEND))
    found = exchanged(sent, tasks).mapInArrow(combine, bundle_schema(PACKS))
    return scratch.keep(found, "ranges"), parts


def remove(docs: DataFrame, ranges: DataFrame, parts: int, unit: Unit, with_text: bool = False, as_was: bool = False) -> DataFrame:
    """``docs`` (id, text, and any others) with what the windows in ``ranges`` cover removed.

    Adds n_symbols, n_removed, n_spans and kept_sha256, and kept_text if asked for. Kept
    words are joined by one space, kept bytes concatenated; with ``as_was`` the kept text of a
    document that loses nothing is its text, null or not.
    """
    names = [c for c in docs.columns if c not in ("id", "text")]
    order = ["id", *names]
    extra = [("n_symbols", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()), *[("kept_text", StringType())] * with_text]
    schema = StructType([*(docs.schema[c] for c in order), *(StructField(c, kind) for c, kind in extra)])

    def run(packs: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_r, tag_r, first_r, stop_r = joined(packs, _RANGE)
        rank = np.argsort(id_r, kind="stable")
        id_r, tag_r, first_r, stop_r = id_r[rank], tag_r[rank], first_r[rank], stop_r[rank]
        for batch in batches:
            ids = batch["id"].to_numpy(zero_copy_only=False) if not batch["id"].null_count else batch["id"].fill_null(0).to_numpy()
            known = batch["id"].is_valid().to_numpy(zero_copy_only=False)
            for rows, off, data in chunks(batch["id"], batch["text"], 1 << 19):
                symbols = unit.symbols(data, off)
                codes, bounds = symbols[0], symbols[3]
                owner, at = _spread(ids[rows], id_r)
                own = (tag_r[at] == text_tags(prefix_sums(codes), bounds)[owner]) & known[rows[owner]]
                owner, at = owner[own], at[own]
                edge = np.bincount(bounds[owner] + first_r[at], minlength=len(codes) + 1) - np.bincount(np.minimum(bounds[owner] + stop_r[at] + unit.window - 1, bounds[owner + 1]), minlength=len(codes) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                begun = gone.copy()
                begun[1:] &= ~gone[:-1]
                heads = bounds[:-1][bounds[:-1] < len(codes)]
                begun[heads] = gone[heads]
                n_removed, n_spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (gone, begun))
                raw, cuts = unit.kept(data, off, symbols, gone)
                pieces = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                cols: dict = {"n_symbols": np.diff(bounds), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in pieces]}
                if with_text:
                    same = n_removed == 0 if as_was else np.zeros(len(rows), bool)
                    cols["kept_text"] = pa.array([batch["text"][int(rows[i])].as_py() if same[i] else x.decode("utf-8", "replace") for i, x in enumerate(pieces)], pa.string())
                rest = batch.slice(int(rows[0]), len(rows))
                yield _batch({c: rest[c] for c in order} | cols)

    return beside(docs.select("id", "text", *names), ranges, parts, run, schema)
