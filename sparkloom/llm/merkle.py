"""Document fingerprints: a Merkle tree over sections and paragraphs.

A document's lines are its paragraphs, runs of lines up to a blank one are its sections.
A fingerprint is the whole tree: equal roots mean equal texts, and where roots differ, walking
down the branches that differ locates the edits. The paragraphs that two trees share tell their
likeness; beside the tree a fingerprint carries the least hashes of the document's byte grams,
for edits inside paragraphs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width
from .textvec import _BYTE, U64, chunks, mix, powers, prefix_sums

GRAM = 6  # bytes; a text has GRAM - 1 zero bytes before and after it, so texts of any length have grams alike
SKETCH = 64


def _h(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


@dataclass(frozen=True)
class Tree:
    root: str
    sections: tuple[bytes, ...]
    paragraphs: tuple[tuple[bytes, ...], ...]
    sizes: tuple[tuple[int, ...], ...]  # bytes of each paragraph, its line end included

    def written(self) -> str:
        """The whole tree as text: the root, and of each section its hash and its paragraphs' hashes and sizes."""
        return ":".join([self.root, *(f"{s.hex()}=" + ",".join(f"{p.hex()}.{n:x}" for p, n in zip(ps, ns, strict=True)) for s, ps, ns in zip(self.sections, self.paragraphs, self.sizes, strict=True))])

    @staticmethod
    def read(text: str) -> Tree:
        root, *sections = text.split(":")
        hashes, paragraphs, sizes = [], [], []
        for s in sections:
            h, _, rest = s.partition("=")
            own = [x.partition(".") for x in rest.split(",")] if rest else []
            hashes.append(bytes.fromhex(h))
            paragraphs.append(tuple(bytes.fromhex(p) for p, _, _ in own))
            sizes.append(tuple(int(n, 16) for _, _, n in own))
        return Tree(root, tuple(hashes), tuple(paragraphs), tuple(sizes))


def tree(text: str | None) -> Tree:
    """The tree of a text; null counts as empty. The root has 16 bytes, branches and leaves have 6."""
    sections: list[list[bytes]] = [[]]
    sizes: list[list[int]] = [[]]
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        sections[-1].append(_h(b"P" + line, 6))
        sizes[-1].append(len(line) + 1)
        if not line.strip():
            sections.append([])
            sizes.append([])
    # the root is over whole lines' full hashes, as sections and leaves are cut short
    above = tuple(_h(b"S" + b"".join(s), 6) for s in sections)
    root = _h(b"R" + b"".join(above) + _h((text or "").encode("utf-8", "surrogatepass"))).hex()
    return Tree(root, above, tuple(map(tuple, sections)), tuple(map(tuple, sizes)))


def differing_branches(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) numbers at which two trees differ; equal subtrees are not entered."""
    if a.root == b.root:
        return []
    out = []
    for s in range(max(len(a.sections), len(b.sections))):
        x, y = (t.paragraphs[s] if s < len(t.sections) else () for t in (a, b))
        if s < len(a.sections) and s < len(b.sections) and a.sections[s] == b.sections[s]:
            continue
        out += [(s, p) for p in range(max(len(x), len(y))) if x[p : p + 1] != y[p : p + 1]]
    return out


def shared_bytes(a: Tree, b: Tree) -> int:
    """The bytes of the paragraphs that two trees have in common, wherever they stand; whole sections meet first."""
    if a.root == b.root:
        return sum(map(sum, a.sizes))
    left: dict[bytes, list[int]] = {}
    for i, h in enumerate(b.sections):
        left.setdefault(h, []).append(i)
    common, rest_a = 0, []
    for i, h in enumerate(a.sections):
        if left.get(h):
            left[h].pop()
            common += sum(a.sizes[i])
        else:
            rest_a.append(i)
    rest_b = Counter(p for spots in left.values() for i in spots for p in b.paragraphs[i])
    for i in rest_a:
        for p, n in zip(a.paragraphs[i], a.sizes[i], strict=True):
            if rest_b[p] > 0:
                rest_b[p] -= 1
                common += n
    return common


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The SKETCH least distinct 32-bit hashes of each text's byte grams, ascending; none of an empty text."""
    out: list[np.ndarray] = []
    arr = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())
    side = GRAM - 1
    for rows, off, data in chunks(arr, arr, 1 << 18):
        padded = np.zeros(len(data) + 2 * side * len(rows), np.uint8)
        padded[np.arange(len(data)) + side * (2 * np.repeat(np.arange(len(rows)), np.diff(off)) + 1)] = data
        sums = prefix_sums(_BYTE[padded])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(padded) + 1, True)[: len(padded) - GRAM + 1]) >> U64(32)
        begin = off[:-1] + 2 * side * np.arange(len(rows))
        for i, n in zip(begin.tolist(), np.diff(off).tolist(), strict=True):
            g = grams[i : i + n + side] if n else grams[:0]
            most = 8 * SKETCH
            if len(g) > 2 * most:
                few = np.unique(g[g < U64((1 << 32) * most // len(g))])
                if len(few) >= SKETCH:
                    out.append(few[:SKETCH])
                    continue
            out.append(np.unique(g)[:SKETCH])
    return out


def written(t: Tree, sketch: np.ndarray) -> str:
    return f"{sketch.astype('>u4').tobytes().hex()}:{t.written()}"


def read(fingerprint: str) -> tuple[Tree, np.ndarray]:
    sketch, _, rest = fingerprint.partition(":")
    return Tree.read(rest), np.frombuffer(bytes.fromhex(sketch), ">u4").astype(np.uint64)


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints."""
    (x, sx), (y, sy) = read(a), read(b)
    return tree_likeness(x, sx, y, sy)


def tree_likeness(a: Tree, sa: np.ndarray, b: Tree, sb: np.ndarray) -> float:
    """1 for equal roots. Else the greater of two Jaccard likenesses: of the bytes in branches that the
    trees have in common, exactly, and of byte grams, estimated from the sketches, which sees edits
    inside paragraphs.
    """
    if a.root == b.root:
        return 1.0
    common = shared_bytes(a, b) if len(sa) and len(sb) else 0
    whole = sum(map(sum, a.sizes)) + sum(map(sum, b.sizes))
    return max(common / (whole - common) if common else 0.0, _alike(sa, sb))


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        both = both[: SKETCH]
    common = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(common, both, assume_unique=True).sum() / len(both))


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, look, ord, id, text: documents dealt by ascending id into ranges, each followed by its next range's first.

    The range bounds are about evenly spaced quantiles, as many as there are shuffle partitions,
    so neither the driver nor a task sees more than its share; they need not be ids that
    occur. A row finds its range by bisection. What each range begins with is found exactly. A row with ``look`` 1 only stands for
    the successor of the range's last document; the last range is followed by the first
    document of all. Null ids come first.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("ord"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.stat.approxQuantile("ord", [i / width for i in range(1, width)], 1 / (4 * width)) if width > 1 else []
    bounds = sorted({max(-(2**63), min(2**63 - 1, int(x))) for x in found if x is not None})
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    dealt = rows.select(bucket("ord").alias("bucket"), "*")
    firsts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.min("ord")).collect())  # a row for each range
    # the range before (of those that hold any) looks at a range's first id
    heads = np.array([first for _, first in firsts], np.int64)
    lookers = np.array([firsts[i - 1][0] for i in range(len(firsts))], np.int32)

    @F.pandas_udf("int")
    def looker(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(heads, ids.to_numpy())
        hit = (at < len(heads)) & (heads[np.minimum(at, len(heads) - 1)] == ids.to_numpy()) if len(heads) else np.zeros(len(ids), bool)
        return pd.Series(np.where(hit, lookers[np.minimum(at, max(0, len(heads) - 1))], -1).astype(np.int32)) if len(heads) else pd.Series(np.full(len(ids), -1, np.int32))

    extra = F.nullif(looker("ord"), F.lit(-1))
    spots = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("look")), F.when(extra.isNotNull(), F.struct(extra.alias("bucket"), F.lit(1).alias("look")))))
    spread = dealt.select("ord", "id", "text", F.inline(spots))
    return spread.repartitionByRange(max(1, len(firsts)), "bucket").sortWithinPartitions("bucket", "look", "ord", "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_at array<struct<section:int,paragraph:int>>"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_at"]
_EDITS = pa.list_(pa.struct([("section", pa.int32()), ("paragraph", pa.int32())]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, their likenesses, and the branches where the two differ.

    The edited text has its last floor(n/4) code points replaced by the first as many (or
    all) of the next document in ascending id; the last document's next is the first. A null
    text is empty, an empty text has an empty sketch and is like nothing but another empty
    text. Rows with one id follow each other by text; a null id comes first. An empty table
    gives an empty result; a single document is its own successor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, with its tree's root and sketch
        for batch in batches:
            rows = list(zip(batch["bucket"].to_pylist(), batch["look"].to_pylist(), batch["id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], strict=True))
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                own = [(*r, tree(r[3]), s) for r, s in zip(part, sketches([r[3] for r in part]), strict=True)]
                pairs = []
                for x, y in zip([held, *own[:-1]], own, strict=True):
                    if x and not x[1] and x[0] == y[0]:
                        n = len(x[3])
                        pairs.append((x, y, x[3][: n - n // 4] + y[3][: n // 4]))
                held = own[-1]
                if not pairs:
                    continue
                edited = [p[2] for p in pairs]
                es = sketches(edited)
                trees = [tree(t) for t in edited]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                        pa.array([written(x[4], x[5]) for x, _, _ in pairs]),
                        pa.array([written(t, s) for t, s in zip(trees, es, strict=True)]),
                        pa.array([tree_likeness(x[4], x[5], t, s) for (x, _, _), t, s in zip(pairs, trees, es, strict=True)], pa.float64()),
                        pa.array([tree_likeness(x[4], x[5], y[4], y[5]) for x, y, _ in pairs], pa.float64()),
                        pa.array([[{"section": s, "paragraph": p} for s, p in differing_branches(x[4], t)] for (x, _, _), t in zip(pairs, trees, strict=True)], _EDITS),
                    ],
                    names=_NAMES,
                )

    return with_successor(docs, id_col, text_col).mapInArrow(run, _OUT)
