"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on one Arrow batch inside a task: the UTF-8 bytes of many
documents lie in one numpy array, and words, rolling hashes and window anchors are
computed with array operations over all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for every byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95) + U64(seed))


_BYTE = _table(7)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the inverse powers; kept between calls."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        b = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, dtype=np.uint64)
        b[0] = 1
        have = _powers[key] = np.cumprod(b, dtype=np.uint64)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[i..j) * base**index, modulo 2**64."""
    s = np.empty(len(values) + 1, np.uint64)
    s[0] = 0
    np.cumsum(values * powers(len(values)), out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A mixed hash of each span's content; equal contents hash equally wherever they stand."""
    return mix((sums[stop] - sums[start]) * powers(len(sums), True)[start] + (stop - start).astype(np.uint64))


def chunks(ids: pa.Array, text: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers' slice as start/stop, byte offsets from 0, bytes) for runs of whole rows.

    A null text counts as empty. A single long text makes a chunk of its own.
    """
    text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield np.arange(i, j), off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many documents: 64-bit hashes, byte starts, byte stops, and where each document's words begin.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D and never cross documents.
    ``lower`` folds A-Z first. The last array has one entry more than there are documents.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    first &= ~space
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    last &= ~space
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(_BYTE[_LOWER[data] if lower else data])
    return span_hash(sums, start, stop), start, stop, np.searchsorted(start, offsets)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every i with i + width <= len(values): where the least of values[i:i+width] lies, by its upper 32 bits; of equal ones the leftmost."""
    m, span = values & U64(0xFFFFFFFF00000000) | np.arange(len(values), dtype=np.uint64), 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: span - width], m[width - span :])
    return (m & U64(0xFFFFFFFF)).view(np.int64)


def anchored(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Cut every window of ``window`` symbols of every document to the anchor it belongs to.

    ``values`` holds a 64-bit code for each symbol of the concatenated documents. A window's
    anchor is the leftmost gram of ``gram`` symbols with the least hash among those that lie
    in it, so equal windows in different documents have their anchor at the same place.
    Returns, for each maximal run of windows with one anchor: the run's first window start,
    its last window start, the anchor's position, and the prefix sums for content hashes.
    """
    sums = prefix_sums(values)
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, sums
    grams = mix((sums[gram:] - sums[:-gram]) * powers(n + 1, True)[: n - gram + 1] ^ U64(0x5851F42D4C957F2D))
    anchor = sliding_argmin(grams, window - gram + 1)  # for window starts 0 .. n - window
    starts = np.arange(n - window + 1)
    doc_stop = np.repeat(offsets[1:], np.diff(offsets))[: n - window + 1]
    inside = starts + window <= doc_stop
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new &= inside
    end = np.empty(len(starts), bool)
    end[-1] = True
    end[:-1] = new[1:] | ~inside[1:]
    end &= inside
    lo, hi = np.flatnonzero(new), np.flatnonzero(end)
    return lo, hi, anchor[lo], sums
