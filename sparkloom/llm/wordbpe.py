"""Whole-text encoding with a word-ending BPE vocabulary, through a cache of words.

The vocabulary's tokenizer drops white space, folds case and ends each word with a marked
token, so a text's ids are those of its space-separated chunks in order. A worker encodes
each chunk once and keeps the packed ids; a text's ids are then a join of cached bytes.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import regex

#: The split pattern of the vocabulary file; files with another one take the slow path.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MOST_CACHED = 500_000
_ODD = re.compile("[\x1c-\x1f\x85İΣ]")
_loaded: dict[str, WordEncoder] = {}
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Packs a text's token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = model.get("end_of_word_suffix") == "</w>" and pre[0].get("pattern", {}).get("Regex") == SPLIT
        self.cache: dict[str, bytes] = {"": b""}
        if self.fast:
            import tiktoken

            byte = _byte_letters()
            ranks = {}
            for token, i in model["vocab"].items():
                if token in self.special:
                    continue
                ends = token.endswith("</w>") and len(token) > 4
                # 0xFF occurs in no UTF-8 text: it stands for the word's end
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = i
            self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self.split = regex.compile(SPLIT).findall

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return (array("I", ids) if LITTLE else np.array(ids, "<u4")).tobytes()

    def chunk(self, chunk: str) -> bytes:
        body = chunk[:-1] if chunk[-1] in ".," else chunk
        if body.isalpha() and (body.isascii() or not _ODD.search(body) and unicodedata.is_normalized("NFC", body)):
            got = self.pack(self.piece(body.lower().encode() + b"\xff"))
            if body is not chunk:
                got += self.cache.get(chunk[-1]) or self.chunk(chunk[-1])
        elif "<|" in chunk or _ODD.search(chunk):
            got = self.pack(self.slow.encode(chunk, add_special_tokens=False).ids)
        else:
            text = unicodedata.normalize("NFC", chunk)
            got = b"".join(self.pack(self.piece(w.encode() + b"\xff")) for w in self.split(text.lower()))
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
            self.cache[""] = b""
        self.cache[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if not self.fast:
            return self.pack(self.slow.encode(text, add_special_tokens=False).ids)
        chunks = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            have, make = self.cache.get, self.chunk
            out = []
            for c in chunks:
                got = have(c)
                out.append(make(c) if got is None else got)
            return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """The encoder for a vocabulary file; loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
