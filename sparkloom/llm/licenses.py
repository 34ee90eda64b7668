"""License scans by patience alignment of texts with license templates.

Where the words of a template gather in a text, the two are aligned: words that occur once in
either and in both anchor the alignment, the longest increasing run of anchors is kept, and
the gaps between them are aligned the same way. The share of the template's words that the
alignment matches is the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Short forms of well-known notices, which scans look for.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by ascending first parts, whose second parts ascend (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), ascending in both.

    Equal ends of a gap match first; then the gap's unique common words anchor it. A gap
    without such words is anchored on its longest common run instead.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a = {w for w, n in Counter(a[i:j]).items() if n == 1}
        once = {w for w, n in Counter(b[k:m]).items() if n == 1 and w in once_a}
        if once:
            spot = {b[y]: y for y in range(k, m) if b[y] in once}
            anchors = increasing([(x, spot[a[x]]) for x in range(i, j) if a[x] in once])
        else:
            best, run = (0, 0, 0), {}
            for x in range(i, j):
                now = {}
                for y in range(k, m):
                    if a[x] == b[y]:
                        now[y] = n = run.get(y - 1, 0) + 1
                        if n > best[0]:
                            best = (n, x - n + 1, y - n + 1)
                run = now
            if not best[0]:
                continue
            anchors = [(best[1] + d, best[2] + d) for d in range(best[0])]
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges[:-1], edges[1:], strict=True) if x2 > x + 1 and y2 > y + 1]
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    needed: tuple[str, ...]  # a text without any of these can't reach the coverage

    @staticmethod
    def of(name: str, text: str, coverage: float) -> Template:
        w = words(text)
        spare = int(len(w) * (1 - coverage) + 1e-9)
        needed, many = [], 0
        for word in sorted(set(w), key=lambda x: (-len(x), x)):
            needed.append(word)
            many += w.count(word)
            if many > spare:
                break
        return Template(name, tuple(w), tuple(needed))


def tightened(pairs: list[tuple[int, int]], part: list[str], words: tuple[str, ...]) -> list[tuple[int, int]]:
    """An alignment whose stray words at either end, far from the rest, are moved to the nearest equal word on the inside."""
    pairs = list(pairs)
    for k in range(len(pairs) - 2, -1, -1):  # leading words as late as the next one allows
        x, y = pairs[k]
        if pairs[k + 1][0] - x > pairs[k + 1][1] - y:
            pairs[k] = (max(i for i in range(x, pairs[k + 1][0]) if part[i] == words[y]), y)
    for k in range(1, len(pairs)):  # and the others as early as the one before allows
        x, y = pairs[k]
        if x - pairs[k - 1][0] > y - pairs[k - 1][1]:
            pairs[k] = (min(i for i in range(pairs[k - 1][0] + 1, x + 1) if part[i] == words[y]), y)
    return pairs


def find(text: str, templates: list[Template], coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, start, stop, matched words) of each place in a text that covers a template; offsets in code points."""
    low = text.lower()
    wanted = [t for t in templates if any(w in low for w in t.needed)]
    if not wanted:
        return []
    tokens = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)] if len(low) == len(text) else [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    found = []
    for t in wanted:
        vocabulary, n = set(t.words), len(t.words)
        seeds = {w for w in vocabulary if len(w) > 3} or vocabulary
        hits = [i for i, (w, _, _) in enumerate(tokens) if w in seeds]
        at = free = 0  # words from ``free`` on belong to no place of this template yet
        while at < len(hits):
            end = at + 1
            while end < len(hits) and hits[end] - hits[end - 1] <= n // 2 + 4 and tokens[hits[end]][0] != tokens[hits[at]][0] or end < len(hits) and hits[end] - hits[at] < n:
                end += 1
            stop = min(len(tokens), hits[end - 1] + n + 1)
            # what lies before a place may hold others; what lies behind it comes next
            todo, places = [(max(free, hits[at] - n), stop)], []
            while todo:
                lo, hi = todo.pop()
                part = [w for w, _, _ in tokens[lo:hi]]
                if len(part) < coverage * n - 1e-9 or len(vocabulary & set(part)) < coverage * len(vocabulary) - 1e-9 and n <= len(vocabulary):
                    continue
                pairs = tightened(align(part, list(t.words)), part, t.words)
                if len(pairs) >= coverage * n - 1e-9:
                    first, last = lo + pairs[0][0], lo + pairs[-1][0]
                    places.append((t.name, len(pairs) / n, tokens[first][1], tokens[last][2], len(pairs)))
                    free = max(free, last + 1)
                    todo.append((lo, first))
            found += sorted(places, key=lambda x: x[2])
            at = max(at + 1, bisect_left(hits, free)) if places else end
    return found


_ONE = "license:string,coverage:double,start:int,stop:int,matched_words:int"


def license_scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_found, the best covered license with its coverage, and all places found.

    The whole of every text is read. A null or empty text finds nothing; of equal coverages
    the earliest place counts as best; repeated rows are scanned each for itself. Templates
    are a small fixed set, sent with the task.
    """
    out = f"doc_id long, n_found int, license string, coverage double, found array<struct<{_ONE}>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32()), ("matched_words", pa.int32())]))
    templates = [Template.of(k, v, coverage) for k, v in notices.items()]
    names = ("license", "coverage", "start", "stop", "matched_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t or "", templates, coverage) for t in batch[1].to_pylist()]
            best = [max(f, key=lambda x: (x[1], -x[2])) if f else (None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0].cast(pa.int64()),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.array([b[0] for b in best], pa.string()),
                    pa.array([b[1] for b in best], pa.float64()),
                    pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], kind),
                ],
                names=["doc_id", "n_found", "license", "coverage", "found"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, out)
