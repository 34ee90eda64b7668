"""Secret scans: patterns of known shapes, and a battery of randomness tests for the rest.

Runs of token characters that no pattern takes are candidates. The smallest alphabet that holds a
candidate's characters is its encoding, and three tests judge it there: chi-squared uniformity of
the symbols, runs above and below the alphabet's middle, and serial correlation. Each test is
asked twice:

- were the symbols drawn at random from the alphabet? A candidate that any test rejects is none;
- does ordinary text look as random as this? The null model is the corpus itself: pairs of
  neighbouring characters, counted over all runs of all documents that are no candidates, give the symbols' frequencies, the chance to
  cross the middle and the correlation that text of this encoding has. The least of
  the three p-values, times three, holds however the tests depend on each other.

Discoveries are controlled for each band of lengths by itself, at a false discovery rate of RATE
(Benjamini-Hochberg over the counts of p-values, rounded up to steps of their logarithm), so the
many short runs don't set the limit of the long ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import erfc, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
HEX_LONG = re.compile("[0-9a-f]{32,}")  # the same matches as HEX of 32 and more
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{20,}")
KINDS = ["assign", "access", "hex", "random"]
SHORTEST = 20
RATE = 0.01
RANDOM_P = 1e-4  # a candidate below it in any test is not random
BANDS = [20, 24, 32, 40, 64, 128, 1024]
STEPS, DEEPEST = 8, 400  # of p-values' binary logarithm

_DIGIT, _LOW, _HIGH = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet up; the first that holds all characters is inferred.
ENCODINGS = {
    "decimal": _DIGIT, "hex": _DIGIT + "abcdef", "hex_upper": _DIGIT + "ABCDEF", "lower": _LOW, "upper": _HIGH, "base32": _HIGH + "234567",
    "lower_digits": _DIGIT + _LOW, "upper_digits": _DIGIT + _HIGH, "letters": _HIGH + _LOW, "base62": _DIGIT + _HIGH + _LOW,
    "base64": _HIGH + _LOW + _DIGIT + "+/", "base64url": _HIGH + _LOW + _DIGIT + "-_", "token": _HIGH + _LOW + _DIGIT + "+/-_",
}
_ALPHABETS = list(ENCODINGS.values())
_CODE = np.full((len(_ALPHABETS), 128), -1, np.int64)
for _e, _a in enumerate(_ALPHABETS):
    _CODE[_e, [ord(c) for c in _a]] = np.arange(len(_a))
_MASK = np.zeros(128, np.int64)  # the encodings a character fits
for _e in range(len(_ALPHABETS)):
    _MASK[_CODE[_e] >= 0] |= 1 << _e


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def free_candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters of SHORTEST or more that no span touches."""
    found = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
    if not taken or not found:
        return found
    starts, reach = [x for x, _, _ in taken], list(accumulate((y for _, _, y in taken), max))
    before = [bisect_left(starts, z) for _, z in found]
    return [(a, z) for (a, z), i in zip(found, before, strict=True) if not i or reach[i - 1] <= a]


def encoding_of(raw: np.ndarray) -> int:
    """The number of the smallest alphabet with all these characters."""
    both = int(np.bitwise_and.reduce(_MASK[raw]))
    return (both & -both).bit_length() - 1


def battery(raw: np.ndarray, encoding: int) -> tuple[float, int, float]:
    """Chi-squared of the symbols against equal shares, changes of side of the middle, and lag-1 correlation."""
    code = _CODE[encoding][raw]
    m, n = len(_ALPHABETS[encoding]), len(code)
    seen = np.bincount(code, minlength=m)
    chi = float((seen * seen).sum()) * m / n - n
    side = code >= m // 2
    changes = int((side[1:] != side[:-1]).sum())
    x = code - (m - 1) / 2
    return chi, changes, float((x[1:] * x[:-1]).sum()) / ((n - 1) * (m * m - 1) / 12)


@dataclass
class Null:
    """What a source of symbols makes of the three statistics: uniform symbols, or the corpus's text."""

    symbols: np.ndarray  # shares
    change: float  # chance that neighbours lie on two sides of the middle
    product: float  # mean product of neighbours about the middle of the alphabet, in variances of a uniform symbol
    spread: float  # its standard deviation

    def moments(self, n: int) -> tuple[tuple[float, float], ...]:
        """(mean, standard deviation) of each statistic over ``n`` symbols."""
        q, m = self.symbols, len(self.symbols)
        s2, s3 = float((q * q).sum()), float((q**3).sum())
        # of the sum over symbols of N(N-1), which is the number of ordered equal pairs
        pairs, var = n * (n - 1) * s2, n * (n - 1) * (4 * (n - 2) * (s3 - s2 * s2) + 2 * (s2 - s2 * s2))
        chi = (m / n * (pairs + n) - n, m / n * sqrt(max(var, 1e-9)))
        k = n - 1
        return chi, (k * self.change, sqrt(max(k * self.change * (1 - self.change), 1e-9))), (self.product, self.spread / sqrt(k))


def uniform(m: int) -> Null:
    low = m // 2
    return Null(np.full(m, 1 / m), 2 * low * (m - low) / m**2, 0.0, 1.0)


def text_nulls(pairs: dict[tuple[int, int], int]) -> list[Null]:
    """Of each encoding the null model of ordinary text, from the corpus's counts of neighbouring characters.

    Alphabets of one case take letters of both cases. A count of one for every pair of symbols
    keeps encodings that the corpus lacks defined: text then looks like random symbols, so
    nothing is found in them.
    """
    seen, folded = np.zeros((128, 128)), np.zeros((128, 128))
    for (a, b), n in pairs.items():
        seen[a, b] += n
        folded[ord(chr(a).lower()), ord(chr(b).lower())] += n
    out = []
    for alphabet in _ALPHABETS:
        one_case = alphabet.lower() == alphabet or alphabet.upper() == alphabet
        own = np.array([ord(c) for c in (alphabet.lower() if one_case else alphabet)])
        m = len(own)
        joint = (folded if one_case else seen)[np.ix_(own, own)] + 1.0
        joint /= joint.sum()
        side = np.arange(m) >= m // 2
        x = (np.arange(m) - (m - 1) / 2) / sqrt((m * m - 1) / 12)
        product = np.outer(x, x)
        mean = float((joint * product).sum())
        out.append(Null((joint.sum(0) + joint.sum(1)) / 2, float(joint[side[:, None] != side].sum()), mean, sqrt(float((joint * (product - mean) ** 2).sum()))))
    return out


def _below(z: float) -> float:
    """The normal share below z."""
    return erfc(-z / sqrt(2)) / 2


def looks_random(n: int, encoding: int, chi: float, changes: int, product: float) -> float:
    """The least two-sided p-value of the battery for symbols drawn at random."""
    z = [(x - mean) / sd for x, (mean, sd) in zip((chi, changes, product), uniform(len(_ALPHABETS[encoding])).moments(n), strict=True)]
    return min(2 * _below(-abs(v)) for v in z)


def text_p(null: Null, m: int, n: int, chi: float, changes: int, product: float) -> float:
    """How likely ordinary text of this encoding and length looks as random: the three tests' p-values, combined.

    Each test looks from the text's mean towards the mean of random symbols; a test whose two
    means agree within the spread says nothing and gives 1/2.
    """
    p = []
    for x, (mean, sd), (there, _) in zip((chi, changes, product), null.moments(n), uniform(m).moments(n), strict=True):
        way = there - mean
        z = (x - mean) / sd * (1 if way > 0 else -1)
        p.append(_below(-z) if abs(way) > 0.5 * sd else 0.5)
    return min(1.0, len(p) * min(p))


def step_of(p: float) -> int:
    """p rounded up to the next step of its binary logarithm: 2 ** (-step / STEPS)."""
    return min(DEEPEST * STEPS // 2, int(-np.log2(max(p, 1e-300)) * STEPS))


def band_of(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def limits(counts: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """Of each band the least step that is a discovery (Benjamini-Hochberg); bands without any are left out."""
    out: dict[int, int] = {}
    for band in {b for b, _ in counts}:
        own = {s: n for (b, s), n in counts.items() if b == band}
        total, upto = sum(own.values()), 0
        for s in sorted(own, reverse=True):
            upto += own[s]
            if 2.0 ** (-s / STEPS) * total <= rate * upto:
                out[band] = s
    return out


_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[ord(c) for c in ENCODINGS["token"]]] = True


def ordinary_pairs(text: str) -> np.ndarray:
    """How often each pair of neighbouring token characters (128 * first + second) stands in runs too short for a candidate."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ok = _IS_TOKEN[data]
    edge = np.flatnonzero(np.diff(ok, prepend=False, append=False))
    long = np.flatnonzero(edge[1::2] - edge[::2] >= SHORTEST)
    for a, z in zip(edge[2 * long].tolist(), edge[2 * long + 1].tolist(), strict=True):
        ok[a:z] = False
    first = np.flatnonzero(ok[:-1] & ok[1:])
    return np.bincount((data[first].astype(np.int64) << 7) | data[first + 1], minlength=1 << 14)
_ROW = "doc_id {kind}, base array<struct<a:int,k:int,z:int>>, tried array<struct<a:int,z:int,encoding:int,chi:double,changes:int,product:double>>, pairs array<struct<pair:int,n:long>>"


def _struct(columns: list[tuple[str, list, pa.DataType]], offsets: list[int]) -> pa.Array:
    inner = pa.StructArray.from_arrays([pa.array(v, t) for _, v, t in columns], names=[c for c, _, _ in columns])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row.

    ``spans`` lists kind:start:end (code points, end exclusive) of all spans, by start, then kind;
    base_sha256 is the hash of the same list of the patterns' spans alone. A null or empty text
    has no spans (and the hash of an empty list). Rows that repeat an id or have none are scanned
    each for itself; an empty table gives no row; other columns are not read. Texts are scanned
    whole, at any length. The corpus's pair counts (at most 66 * 66), the histogram of p-values
    (bands * steps) and the limits are all that reaches the driver.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 14, np.int64)
        id_type = None

        def out(ids: pa.Array, base: list, tried: list, pairs: list) -> pa.RecordBatch:
            cuts = [np.cumsum([0, *map(len, x)]).tolist() for x in (base, tried, pairs)]
            flat = [[v for own in x for v in own] for x in (base, tried, pairs)]
            i32, i64, f64 = pa.int32(), pa.int64(), pa.float64()
            kinds = [[("a", i32), ("k", i32), ("z", i32)], [("a", i32), ("z", i32), ("encoding", i32), ("chi", f64), ("changes", i32), ("product", f64)], [("pair", i32), ("n", i64)]]
            lists = [_struct([(c, [v[i] for v in f], t) for i, (c, t) in enumerate(k)], cut) for f, k, cut in zip(flat, kinds, cuts, strict=True)]
            return pa.RecordBatch.from_arrays([ids, *lists], names=["doc_id", "base", "tried", "pairs"])

        for batch in batches:
            id_type = batch[0].type
            texts = batch[1].to_pylist()
            for k in range(0, len(texts), 256):
                base, tried = [], []
                for text in texts[k : k + 256]:
                    if not text:
                        base.append([])
                        tried.append([])
                        continue
                    own = base_spans(text)
                    base.append(own)
                    mine = []
                    for a, z in free_candidates(text, own):
                        raw = np.frombuffer(text[a:z].encode(), np.uint8)
                        e = encoding_of(raw)
                        mine.append((a, z, e, *battery(raw, e)))
                    tried.append(mine)
                    seen += ordinary_pairs(text)
                yield out(batch[0].slice(k, len(base)), base, tried, [[]] * len(base))
        if seen.any():
            own = np.flatnonzero(seen)
            yield out(pa.nulls(1, id_type), [[]], [[]], [list(zip(own.tolist(), seen[own].tolist(), strict=True))])

    made = scratch.keep(rows.mapInArrow(scan, _ROW.format(kind=kind)), "scanned")
    counted = made.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n")).collect()  # at most 66 * 66 rows
    nulls = text_nulls({(r["pair"] >> 7, r["pair"] & 127): r["n"] for r in counted})

    def judged(mine: list[dict]) -> list[tuple[int, int, int, int]]:
        """(start, end, band, step) of the candidates that look random."""
        found = []
        for c in mine:
            n, e = c["z"] - c["a"], c["encoding"]
            if looks_random(n, e, c["chi"], c["changes"], c["product"]) >= RANDOM_P:
                found.append((c["a"], c["z"], band_of(n), step_of(text_p(nulls[e], len(_ALPHABETS[e]), n, c["chi"], c["changes"], c["product"]))))
            else:
                found.append((c["a"], c["z"], band_of(n), 0))
        return found

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[tuple[int, int], int] = {}
        for batch in batches:
            for mine in batch["tried"].to_pylist():
                for _, _, band, step in judged(mine):
                    many[band, step] = many.get((band, step), 0) + 1
        if many:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in many], pa.int32()), pa.array([s for _, s in many], pa.int32()), pa.array(list(many.values()), pa.int64())], names=["band", "step", "n"])

    some = made.where(F.size("tried") > 0).select("tried").mapInArrow(histogram, "band int, step int, n long")
    least = limits({(r["band"], r["step"]): r["n"] for r in some.groupBy("band", "step").agg(F.sum("n").alias("n")).collect()}, rate)  # bands * steps

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[(s["a"], s["k"], s["z"]) for s in own] for own in batch["base"].to_pylist()]
            more = [[(a, 3, z) for a, z, band, step in judged(mine) if step and step >= least.get(band, 1 << 30)] for mine in batch["tried"].to_pylist()]
            cols = [batch["doc_id"], *(pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(3))]
            cols += [pa.array([hashlib.sha256(spelled(own).encode()).hexdigest() for own in base], pa.string()), pa.array([spelled(sorted(x + y)) for x, y in zip(base, more, strict=True)], pa.string()), pa.array([len(x) for x in more], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    out_schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return made.where(F.size("pairs") == 0).drop("pairs").mapInArrow(finish, out_schema)
