"""Token counts: offset-mapped attribution of tokens to the sections of a document.

Each whole document is encoded once. The byte span of every token follows from its
vocabulary entry, sections are byte spans too, and a merge of the two sorted span lists
attributes tokens. A token that crosses a boundary goes to the section that holds most of
its bytes, on a tie to the earlier one; its bytes in each section are reported as well.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import vocabulary

#: The pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Long runs of what the pattern's white space matches; it would backtrack over each of them as a whole.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
_loaded: dict[str, tuple] = {}


class Encoder:
    """Encodes whole texts. A long blank run is one piece of the pattern, less its last character where
    text follows; it is encoded as such beside the pattern, with the same ids.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.piece = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in BLANKS.finditer(text):
            stop = m.end() - (m.end() < len(text))
            ids += self.plain(text[at : m.start()]) + self.piece(text[m.start() : stop])
            at = stop
        return ids + self.plain(text[at:]) if at else self.plain(text)


def encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """The encoding at ``path`` and the byte length of every token; loaded once a worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _loaded[path] = Encoder(ranks), size
    return _loaded[path]


def sections(text: str, raw: bytes) -> np.ndarray:
    """Byte offsets at which the sections of a text begin: after each line end, and 0."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(raw)]]) if len(raw) else np.zeros(1, np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each section: tokens allocated, tokens that touch it, and tokens of these that cross a boundary.

    ``ends`` are the tokens' end offsets (contiguous from 0), ``starts`` the sections' starts.
    """
    k = len(starts)
    stops = np.append(starts[1:], total)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    given = np.bincount(first[first == last], minlength=k)
    touch, cross = given.copy(), np.zeros(k, np.int64)
    for t in np.flatnonzero(first != last):
        spots = np.arange(first[t], last[t] + 1)
        part = np.minimum(stops[spots], ends[t]) - np.maximum(starts[spots], begins[t])
        given[spots[part.argmax()]] += 1
        touch[spots] += 1
        cross[spots] += 1
    return given, touch, cross


_OUT = "doc_id long, section int, start_char long, stop_char long, n_bytes long, n_tokens long, n_touching long, n_crossing long"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """A row for each section (line) of each document; the sections' n_tokens add up to the document's tokens.

    ``path`` is the vocabulary's file, else the public one called ``name``. A null or empty text
    gives one section of no tokens, an empty table no row. Repeated rows are counted each for
    itself; other columns are not read. A text may be of any length, blank runs included.
    """
    path = path or vocabulary(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(path)
        for batch in batches:
            ids, texts = batch[0].to_pylist(), batch[1].to_pylist()
            for k in range(0, len(ids), 512):
                cols: list[list] = [[] for _ in range(8)]
                for doc, text in zip(ids[k : k + 512], texts[k : k + 512], strict=True):
                    text = text or ""
                    raw = text.encode("utf-8", "surrogatepass")
                    starts = sections(text, raw)
                    got = np.asarray(enc.encode(text), dtype=np.int64) if text else np.zeros(0, np.int64)
                    given, touch, cross = attribute(np.cumsum(size[got]), starts, len(raw))
                    stops = np.append(starts[1:], len(raw))
                    if text.isascii():
                        a, b = starts, stops
                    else:
                        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        a, b = chars[starts], chars[stops]
                    for c, v in zip(cols, ([doc] * len(starts), range(len(starts)), a.tolist(), b.tolist(), (stops - starts).tolist(), given.tolist(), touch.tolist(), cross.tolist()), strict=True):
                        c.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=[c.split()[0] for c in _OUT.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, _OUT)
