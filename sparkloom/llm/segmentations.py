"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k.

A text's segmentations are the paths of a lattice of vocabulary pieces. Pieces weigh by their
rank, and sums over the lattice from its end make every step's choice a probability. A
perturbed A-star search walks it from the start: an open node stands for all the completions of
a partial path that take none of some choices at its next step, and its key is the greatest
Gumbel-perturbed log probability among them. The best open node is taken, one completion walked
to the end under its key, and what every step of the walk did not choose becomes an open node,
with a key drawn below the walk's. The first k paths are k distinct segmentations sampled without
replacement; the best key still open after them gives each one's inclusion probability.

Walks of many texts run together, a step of all their words at a time, over one table of distinct
words, which a worker keeps from batch to batch. Noise is a hash of the row's key, the walk, the
word and the step, so it depends on nothing else.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from math import exp, expm1, fsum, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary
from .textvec import U64, mix

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
BATCH_CHARS = 300_000  # of the texts whose walks run together
MOST_STATES = 2_000_000  # a worker's table of words starts anew beyond them: about 100 bytes each
FEW = 8  # words or fewer are walked one by one
HEAD = 32  # steps of a walk whose open nodes are looked at first
MOST_GUMBEL = 36.75  # no standard Gumbel variable made from ``uniform`` is greater
_loaded: dict[tuple[str, float], SubwordModel] = {}


class Trie:
    """The pieces' common starts as one table of moves: from a node by a character's class to the next node, 0 for none.

    The most frequent classes have dense rows, the others lie in a sorted list of moves.
    """

    DENSE = 96

    def __init__(self, pieces: list[str]):
        counts: dict[str, int] = {}
        for p in pieces:
            for c in p:
                counts[c] = counts.get(c, 0) + 1
        ranked = sorted(counts, key=lambda c: (-counts[c], c))
        number = {c: i for i, c in enumerate(ranked)}
        self.many = len(ranked) + 1
        code = np.array([ord(c) for c in ranked], np.uint32)
        order = np.argsort(code)
        self.codes, self.classes = code[order], order
        self.low = np.full(1 << 16, self.many - 1)
        self.low[code[code < 1 << 16]] = np.flatnonzero(code < 1 << 16)
        moves: dict[int, int] = {}
        self.piece = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for c in p:
                key = node * self.many + number[c]
                node = moves.setdefault(key, len(self.piece))
                if node == len(self.piece):
                    self.piece.append(-1)
            self.piece[node] = k
        self.piece = np.array(self.piece)
        keys = np.array(list(moves), np.int64)
        to = np.array(list(moves.values()), np.int32)
        node, cls = keys // self.many, keys % self.many
        self.table = np.zeros((len(self.piece), self.DENSE), np.int32)
        self.table[node[cls < self.DENSE], cls[cls < self.DENSE]] = to[cls < self.DENSE]
        rare = np.argsort(keys)
        rare = rare[cls[rare] >= self.DENSE]
        self.rare, self.rare_to = np.append(keys[rare], np.iinfo(np.int64).max), np.append(to[rare], 0)

    def class_of(self, points: np.ndarray) -> np.ndarray:
        """Each code point's class; one that no piece has gets the last."""
        out = self.low[np.minimum(points, (1 << 16) - 1)]
        odd = np.flatnonzero(points >= 1 << 16)
        if len(odd):
            at = np.minimum(np.searchsorted(self.codes, points[odd]), len(self.codes) - 1)
            out[odd] = np.where(self.codes[at] == points[odd], self.classes[at], self.many - 1)
        return out

    def move(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = self.table.ravel().take(node.astype(np.int64) * self.DENSE + np.minimum(cls, self.DENSE - 1))
        odd = np.flatnonzero(cls >= self.DENSE)
        if len(odd):
            key = node[odd].astype(np.int64) * self.many + cls[odd]
            at = np.searchsorted(self.rare, key)
            out[odd] = np.where(self.rare[at] == key, self.rare_to[at], 0)
        return out


class SubwordModel:
    """The pieces of a SentencePiece model, weighted by rank to the power ``-sharpness``.

    The file is of the BPE kind, whose scores are the pieces' ranks below zero, no log
    probabilities; the weights make a distribution of them.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.pieces = [self.lib.id_to_piece(i) for i in range(n)]
        odd = [self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) for i in range(n)]
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in range(n) if self.lib.is_byte(i)}
        ranked = sorted((i for i in range(n) if not odd[i]), key=lambda i: (-self.lib.get_score(i), i))
        self.weight = {self.pieces[i]: (i, -sharpness * log(k + 2)) for k, i in enumerate(ranked)}
        self.byte_weight = -sharpness * log(n + 2)
        self.trie = Trie([self.pieces[i] for i in ranked])
        self.ranked_id = np.array(ranked, np.int64)
        self.ranked_weight = -sharpness * np.log(np.arange(len(ranked)) + 2.0)
        self.byte_id = np.array([self.byte[b] for b in range(256)], np.int64)
        spelled = [bytes((int(p[1:-1], 16),)) if self.lib.is_byte(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_size = np.array([len(x) for x in spelled], np.int32)
        self.spell_at = np.cumsum(self.spell_size, dtype=np.int32) - self.spell_size
        self.lattices = Lattices(self)

    @staticmethod
    def normal(text: str) -> str:
        """A text as the pieces spell it: spaces marked, one put before."""
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text that ids spell; bytes that make no character are replaced."""
        text = self.spell(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's bytes stop."""
        size = self.spell_size[ids]
        stop = np.cumsum(size)
        if len(ids) > 1 << 24:
            return self.spelled[ragged(self.spell_at[ids], size)], stop
        places = np.repeat(self.spell_at[ids] - stop.astype(np.int32) + size, size)
        places += np.arange(len(places), dtype=np.int32)
        return self.spelled.take(places), stop

    def words(self, text: str) -> list[str]:
        """The words of a whole text, normalised; pieces don't cross their starts."""
        return _CHUNK.findall(self.normal(text))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., as many as size[0], then those from start[1] on."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - stop + size, size)


def model(path: str, sharpness: float = 1.0) -> SubwordModel:
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = SubwordModel(path, sharpness)
    return _loaded[path, sharpness]


class Numbers(dict):
    """The numbers of words (without the space put before) in the order in which they first came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattices:
    """The lattices of distinct words: positions are states, steps are numbered through, those of a state together.

    Of each word: its first state. Of each state: where its steps begin, and a row of the two numbers between which
    a uniform one draws its likeliest step, that step and the state it leads to. Of each step: its state, the state it leads to (-1: the word's end), the sum of
    its state's probabilities up to it, and a row of its log probability given the state and its id; a step of several
    ids (-1 - k) has them in a list. A word's numbers don't depend on which words came before.
    """

    STATE = {"first": (np.int32, 1), "likely": (np.float64, 4)}
    STEP = {"state": (np.int32, 1), "after": (np.int32, 1), "cum": (np.float64, 1), "worth": (np.float64, 2)}

    def __init__(self, m: SubwordModel):
        self.m = m
        self._make_room()
        self.clear()

    def _make_room(self) -> None:
        for c, (t, wide) in (self.STATE | self.STEP).items():
            setattr(self, c, np.zeros((1, wide) if wide > 1 else 1, t))

    def clear(self) -> None:
        if len(self.likely) > 3 * MOST_STATES:  # a very long text's
            self._make_room()
        self.number = Numbers()
        self.word_state = np.zeros(0, np.int64)
        self.states = self.steps = 0
        self.odd_ids: list[np.ndarray] = []

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words, whose lattices are made if they are new."""
        if self.states > MOST_STATES:
            self.clear()
        out = []
        for t in texts:
            if not t or SPACE in t or "  " in t or t[0] == " " or t[-1] == " ":
                own = [w[1:] for w in self.m.words(t)]
            else:  # the same
                own = t.split(" ")
            out.append(np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)))
        if len(self.number) > len(self.word_state):
            self._add(list(islice(self.number, len(self.word_state), None)))
        return out

    def _put(self, have: int, **columns: np.ndarray) -> None:
        for c, v in columns.items():
            held = getattr(self, c)
            if have + len(v) > len(held):
                held = np.empty((max(have + len(v), 2 * len(held)), *held.shape[1:]), held.dtype)
                held[:have] = getattr(self, c)[:have]
                setattr(self, c, held)
            held[have : have + len(v)] = v

    def _add(self, words: list[str]) -> None:
        m = self.m
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-size, kind="stable")
        size = size[order]
        points = np.frombuffer((SPACE + SPACE.join([words[i] for i in order.tolist()])).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        # states in levels by how far their word's end is, longer words first: a level's steps lie together, and lead to levels before
        level = np.concatenate([[0, 0], np.cumsum(len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1)))])
        start = np.cumsum(size) - size
        left = np.repeat(start + size, size) - np.arange(n)
        state_of = level[left] + np.repeat(np.arange(len(size)), size)
        cls = m.trie.class_of(points)
        at, node, ahead = np.arange(n), np.zeros(n, np.int32), 0
        many = np.zeros(n, np.int64)
        spots, ranks, stops, found = [], [], [], []
        while len(at):
            node = m.trie.move(node, cls[at + ahead])
            go = np.flatnonzero(node > 0)
            at, node, ahead = at[go], node[go], ahead + 1
            piece = m.trie.piece[node]
            hit = np.flatnonzero(piece >= 0)
            spot, piece = at[hit], piece[hit]
            if ahead == 1:  # a character that is no piece is spelled by its bytes
                whole = np.full(n, -1)
                whole[spot] = piece
                spot, piece = np.arange(n), whole
            last = left[spot] == ahead
            spots.append(spot)
            ranks.append(many[spot])
            stops.append(np.where(last, n, state_of[np.where(last, 0, spot + ahead)]))
            found.append(piece)
            many[spot] += 1
            more = np.flatnonzero(left[at] > ahead)
            at, node = at[more], node[more]
        count = np.empty(n, np.int64)
        count[state_of] = many
        first = np.concatenate([[0], np.cumsum(count)])
        steps = int(first[-1])
        stop, piece = np.empty(steps, np.int64), np.empty(steps, np.int64)
        for spot, rank, to, p in zip(spots, ranks, stops, found, strict=True):
            place = first[state_of[spot]] + rank
            stop[place], piece[place] = to, p
        state = np.repeat(np.arange(n), count)
        weight, ids = m.ranked_weight[piece], m.ranked_id[piece]
        own = np.flatnonzero(piece < 0)
        if len(own):
            point = np.empty(n, np.uint32)
            point[state_of] = points
            for i, c in zip(own.tolist(), map(chr, point[state[own]].tolist()), strict=True):
                raw = m.byte_id[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)]
                weight[i] = m.byte_weight * len(raw)
                ids[i] = raw[0] if len(raw) == 1 else -1 - len(self.odd_ids)
                if len(raw) > 1:
                    self.odd_ids.append(raw)
        # sums from the words' ends, a level at a time
        after = np.zeros(n + 1)
        total = np.empty(steps)
        for a, z in zip(level[1:-1].tolist(), level[2:].tolist(), strict=True):
            x, y = first[a], first[z]
            sums = weight[x:y] + after[stop[x:y]]
            total[x:y] = sums
            begin = first[a:z] - x
            most = np.maximum.reduceat(sums, begin)
            after[a:z] = most + np.log(np.add.reduceat(np.exp(sums - np.repeat(most, count[a:z])), begin))
        log_p = np.minimum(total - after[state], 0.0)
        log_p[first[:-1][count == 1]] = 0.0
        p = np.exp(log_p)
        cum, top = p.copy(), first[:-1].copy()
        for rank in range(1, int(count.max())):
            these = np.flatnonzero(count > rank)
            place = first[these] + rank
            cum[place] += cum[place - 1]
            top[these] = np.where(p[place] > p[top[these]], place, top[these])
        cum[first[1:] - 1] = 1.0
        low = np.where(top > first[:-1], cum[top - 1], 0.0)
        base, from_ = self.states, self.steps
        after = np.where(stop == n, -1, stop + base)
        self._put(base, first=first + from_, likely=np.column_stack([low, cum[top], top + from_, after[top]]))
        self._put(from_, state=state + base, after=after, cum=cum, worth=np.column_stack([log_p, ids]))
        begun = np.empty(len(size), np.int64)
        begun[order] = level[size] + np.arange(len(size)) + base
        self.word_state = np.concatenate([self.word_state, begun])
        self.states, self.steps = base + n, from_ + steps

    def chosen(self, state: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step that a uniform number draws at each state, and the state it leads to."""
        low, high, here, after = np.take(self.likely, state, axis=0).T
        here, after = here.astype(np.int64), after.astype(np.int64)
        other = np.flatnonzero((u < low) | (u >= high))
        if len(other):
            u, step = u[other], self.first[state[other]]
            go = np.flatnonzero(self.cum[step] <= u)  # ends, as a state's last sum is 1
            while len(go):
                step[go] += 1
                go = go[self.cum[step[go]] <= u[go]]
            here[other], after[other] = step, self.after[step]
        return here, after

    def walked(self, state: int, noise: int) -> list[int]:
        """The steps from a state to its word's end, one after the other: what ``chosen`` draws by ``uniform``."""
        steps, most = [], (1 << 64) - 1
        while state >= 0:
            x = (noise ^ noise >> 30) * 0xBF58476D1CE4E5B9 & most
            x = (x ^ x >> 27) * 0x94D049BB133111EB & most
            u = min((((x ^ x >> 31) >> 11) + 0.5) * 2.0**-53, 1 - 2.0**-53)
            low, high, step, after = self.likely[state].tolist()
            if not low <= u < high:
                step = int(self.first[state])
                while self.cum[step] <= u:
                    step += 1
                after = self.after[step]
            steps.append(int(step))
            state, noise = int(after), noise + int(_STEP) & most
        return steps

    def listed(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of steps with those of several written out, and where the cuts between steps are among them."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, cuts
        lists = [self.odd_ids[-1 - i] for i in ids[odd].tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = [len(x) for x in lists]
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = np.repeat(ids, size)
        ids[ragged(begin[odd], size[odd])] = np.concatenate(lists)
        return ids, begin[cuts]


def uniform(noise: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    bits = mix(noise)
    bits >>= U64(11)
    out = bits.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return np.minimum(out, 1 - 2.0**-53, out=out)


def lowered(limit: np.ndarray, loc: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables about ``loc`` that are known to lie below ``limit``."""
    return -np.logaddexp(-limit, np.log(-np.log(u)) - loc)


_WALK, _WORD, _STEP, _OTHER = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
#: An open node: minus its key, a tie break, the steps before it, its state, their log probability, its word, the steps there that are taken.
Node = tuple[float, int, np.ndarray, int, float, int, tuple[int, ...]]
#: A walk to do: text, key, the steps kept, the first word to cross, the state in it (-1: its start).
Start = tuple[int, float, np.ndarray, int, int]


def _branch(lattices: Lattices, node: Node, i: int, u: list[float], tie: int) -> tuple[Start, Node | None]:
    """The walk that takes an open node, and the node that is open there still."""
    key, _, kept, state, before, word, taken = node
    a, z = lattices.first[state : state + 2].tolist()
    options = [x for x in range(a, z) if x not in taken]
    log_p = lattices.worth[a:z, 0].tolist()
    p = [exp(log_p[x - a]) for x in options]
    want, j = u[0] * sum(p), 0
    reached = p[0]
    while reached <= want and j < len(p) - 1:
        j += 1
        reached += p[j]
    left, step = fsum(p[:j] + p[j + 1 :]), options[j]
    rest = None
    if left > 0:
        low, high = sorted((key, log(-log(u[1])) - before - log(left)))
        rest = (high + log1p(exp(low - high)), tie, kept, state, before, word, (*taken, step))
    to = int(lattices.after[step])
    return (i, -key, np.append(kept, np.int32(step)), word + (to < 0), to), rest


def _opened(keys: np.ndarray, log_p: np.ndarray, fall: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: Callable, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``need`` best open nodes of each walk with new steps at begin..begin + size: the walk, the place, the key.

    ``fall`` is minus the log probability before a step. It ascends along a walk, and a key lies above minus
    ``fall`` by MOST_GUMBEL at most. So the first steps' keys tell where the others end that can be among the best,
    and how near to 1 the uniform number of one of these has to be; the keys of those alone are computed.
    """

    def valued(walk: np.ndarray, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        return lowered(keys[walk], np.log(-np.expm1(log_p[at])) - fall[at], u)

    def best(walk: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((at, -key, walk))
        walk, at, key = walk[order], at[order], key[order]
        rank = np.arange(len(walk)) - np.searchsorted(walk, walk)
        kept = rank < need
        return walk[kept], at[kept], key[kept], rank[kept]

    near = np.minimum(size, HEAD)
    walk, at = np.repeat(np.arange(len(size)), near), ragged(begin, near)
    open_ = np.flatnonzero(log_p[at] < 0)
    walk, at = walk[open_], at[open_]
    walk, at, key, rank = best(walk, at, valued(walk, at, uniform(hashes(walk, at))))
    least = np.full(len(size), -np.inf)
    last = rank == need - 1
    least[walk[last]] = key[last]
    reach = [int(np.searchsorted(fall[a:z], x)) for a, z, x in zip((begin + near).tolist(), (begin + size).tolist(), (MOST_GUMBEL - least).tolist(), strict=True)]
    more, places = np.repeat(np.arange(len(size)), reach), ragged(begin + near, np.array(reach, np.int64))
    u = uniform(hashes(more, places))
    kept = np.flatnonzero((1 - u <= np.exp(np.minimum(-fall[places] - least[more], 1.0)) * (1 + 1e-9)) & (log_p[places] < 0))
    more, places, u = more[kept], places[kept], u[kept]
    return best(np.concatenate([walk, more]), np.concatenate([at, places]), np.concatenate([key, valued(more, places, u)]))[:3]


def sample_batch(m: SubwordModel, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text at most k distinct segmentations in sampled order: ids, log probability, inclusion probability.

    Where there are k segmentations or fewer all are returned, each included for certain.
    """
    lattices = m.lattices
    known = lattices.words(texts)
    many = np.array([len(w) for w in known], np.int64)
    out: list[list[tuple[np.ndarray, float, float]]] = [[] if n else [(np.zeros(0, np.int64), 0.0, 1.0)] for n in many.tolist()]
    if not many.any():
        return out
    first_state = lattices.word_state[np.concatenate(known)]
    text_begin = np.cumsum(many) - many
    seeds = seeds.view(np.uint64)
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]  # of each path: ids, log probability, key
    heaps: list[list[Node]] = [[] for _ in texts]
    with np.errstate(over="ignore"):
        roots = -np.log(-np.log(uniform(mix(seeds * _WALK + _OTHER))))
    tie = 0
    for turn in range(k):
        starts: list[Start] = []
        if turn:
            with np.errstate(over="ignore"):
                noise = mix(seeds + _WALK * U64(turn))
                noise = uniform(noise[:, None] + _OTHER * np.arange(1, 3, dtype=np.uint64)).tolist()
            for i, heap in enumerate(heaps):
                if heap:
                    tie += 1
                    start, rest = _branch(lattices, heapq.heappop(heap), i, noise[i], tie)
                    starts.append(start)
                    if rest:
                        heapq.heappush(heap, rest)
        else:
            starts = [(i, key, np.zeros(0, np.int32), 0, -1) for i, key in enumerate(roots.tolist()) if many[i]]
        if not starts:
            break
        # all words that the walks still have to cross; a word left midway goes on from its state
        text = np.array([x[0] for x in starts])
        word = np.array([x[3] for x in starts])
        mid = np.array([x[4] for x in starts])
        count = many[text] - word
        stop = np.cumsum(count)
        begin = stop - count
        at = first_state[ragged(text_begin[text] + word, count)]
        at[begin[mid >= 0]] = mid[mid >= 0]
        with np.errstate(over="ignore"):
            noise = mix(seeds[text] + _WALK * U64(turn + 1)) + _WORD * (word - begin).astype(np.uint64)
            noise = np.repeat(noise, count) + _WORD * np.arange(len(at), dtype=np.uint64)
            taken = np.zeros(len(at), np.int64)
            live, now, seen = np.arange(len(at)), noise, []
            while len(live) > FEW:
                here, at = lattices.chosen(at, uniform(now))
                seen.append((live, here))
                taken[live] = len(seen)
                go = np.flatnonzero(at >= 0)
                live, at, now = live[go], at[go], now[go] + _STEP
        ends = [(p, lattices.walked(s, x)) for p, s, x in zip(live.tolist(), at.tolist(), now.tolist(), strict=True)]
        for p, own in ends:
            taken[p] += len(own)
        sums = np.concatenate([[0], np.cumsum(taken)])
        new = sums[stop] - sums[begin]
        kept = np.array([len(x[2]) for x in starts])
        cuts = np.concatenate([[0], np.cumsum(kept + new)])
        steps = np.empty(cuts[-1], np.int32)
        place = sums[:-1] + np.repeat(cuts[:-1] + kept - sums[begin], count)
        for n, (live, here) in enumerate(seen):
            steps[place[live] + n] = here
        for p, own in ends:
            steps[place[p] + len(seen) : place[p] + taken[p]] = own
        for a, x in zip(cuts.tolist(), starts, strict=False):
            steps[a : a + len(x[2])] = x[2]
        log_p, ids = np.take(lattices.worth, steps, axis=0).T
        ids, id_cuts = lattices.listed(ids.astype(np.int32), cuts)
        fall = np.zeros(len(steps) + 1)
        for x, a, z, b, e in zip(starts, cuts.tolist(), cuts[1:].tolist(), id_cuts.tolist(), id_cuts[1:].tolist(), strict=False):
            sums_ = np.cumsum(-log_p[a:z])
            fall[a + 1 : z] = sums_[:-1]
            found[x[0]].append((ids[b:e], -float(sums_[-1]), x[1]))
        owner = np.repeat(np.arange(len(taken)), taken)
        shift = sums[begin] - cuts[:-1] - kept

        def hashes(walk: np.ndarray, at: np.ndarray, owner=owner, shift=shift, sums=sums, noise=noise) -> np.ndarray:
            own = owner[shift[walk] + at]
            with np.errstate(over="ignore"):
                return (noise[own] + _STEP * (shift[walk] + at - sums[own]).astype(np.uint64)) ^ _OTHER

        keys = np.array([x[1] for x in starts])
        walk, site, key = _opened(keys, log_p, fall, cuts[:-1] + kept, new, hashes, k - turn)
        own = owner[shift[walk] + site] - begin[walk] + word[walk]
        taking = steps[site]
        nodes = (text[walk], key, cuts[walk], site, lattices.state[taking], -fall[site], own, taking)
        for i, value, a, z, state, before, w, step in zip(*(x.tolist() for x in nodes), strict=True):
            tie += 1
            heapq.heappush(heaps[i], (-value, tie, steps[a:z].copy(), state, before, w, (step,)))
    for i, paths in enumerate(found):
        threshold = -heaps[i][0][0] if heaps[i] else None
        for ids, total, _ in paths:
            share = 1.0 if threshold is None else -expm1(-exp(min(total - threshold, 50.0)))
            out[i].append((ids, total, share))
    return out


def _columns(m: SubwordModel, texts: list[str], seeds: np.ndarray, k: int) -> tuple[np.ndarray, list[list]]:
    """The samples of texts as columns: each one's text; its number, n_pieces, log_p, inclusion, ids_crc32, round_trip, ids."""
    groups = sample_batch(m, texts, seeds, k)
    cols: list[list] = [[] for _ in range(7)]
    for text, found in zip(texts, groups, strict=True):
        plain = m.normal(text).encode()
        raw, stops = m.spell(np.concatenate([ids for ids, *_ in found]))
        data, at, a = raw.tobytes(), 0, 0
        for n, (got, log_p, share) in enumerate(found):
            at += len(got)
            z = int(stops[at - 1]) if at else 0
            same = data[a:z] == plain or m.decode(got) == text.replace(SPACE, " ")
            a = z
            for c, v in zip(cols, (n, len(got), round(log_p, 9), round(share, 9), zlib.crc32(got.astype("<u4")), same, got), strict=True):
                c.append(v)
    return np.repeat(np.arange(len(texts)), [len(found) for found in groups]), cols


def sampled(rows: DataFrame, keys: list[str], text_col: str = "text", k: int = 4, path: str | None = None, sharpness: float = 1.0, ids: bool = False) -> DataFrame:
    """A row per sampled segmentation: the keys, sample (from 0), n_pieces, log_p, inclusion, ids_crc32, round_trip (and ids).

    The seed is a hash of the row's keys alone, so it doesn't depend on partitions or order;
    rows that repeat a key and a text repeat its samples. round_trip tells whether decoding gives
    the text back as the vocabulary spells it. A null or empty text has the empty segmentation
    only, certainly included. Whole texts are segmented, however long. Ids are packed for
    ids_crc32 as little-endian unsigned 32-bit numbers.
    """
    file = path or vocabulary(MODEL)
    kinds = [(c, dict(rows.dtypes)[c]) for c in keys]
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds) + ", sample int, n_pieces int, log_p double, inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    names = [*keys, "sample", "n_pieces", "log_p", "inclusion", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file, sharpness)
        for batch in batches:
            texts = batch["__text"].to_pylist()
            seeds = batch["__seed"].to_numpy(zero_copy_only=False)
            sizes = np.cumsum([len(t or "") for t in texts])
            a = 0
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_CHARS, "right")))
                take, cols = _columns(m, [t or "" for t in texts[a:z]], seeds[a:z], k)
                kept = batch.select(keys).take(pa.array(take + a, pa.int64()))
                types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made[: 6 + ids]], names=[*names, *["ids"] * ids])
                a = z

    seed = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys], F.lit(17))
    return rows.select(*keys, F.col(text_col).alias("__text"), seed.alias("__seed")).mapInArrow(run, schema)


def encoded(rows: DataFrame, keys: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The keys and ids: the library's own encoding of each whole text; null and empty texts have no ids."""
    file = path or vocabulary(MODEL)
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        for batch in batches:
            got = m.lib.encode([t or "" for t in batch["__text"].to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, pa.array(got, pa.list_(pa.int32()))], names=[*keys, "ids"])

    return rows.select(*keys, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, keys: list[str], ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The keys and text that each row's ids spell; null ids count as none."""
    file = path or vocabulary(MODEL)
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        for batch in batches:
            got = [m.decode(x or []) for x in batch["__ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, pa.array(got, pa.string())], names=[*keys, "text"])

    return rows.select(*keys, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
