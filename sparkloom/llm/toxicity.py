"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training sees documents' labels only. In a bounded sample of labelled documents, tokens whose
word or affix is much likelier in toxic documents are labelled toxic where they stand in a
toxic document, all others clean; on those labelled tokens the field is fitted. Its states
are clean and toxic, its emissions a token's word and affixes, its transitions all four.
Forward-backward marginals give each token's probability; a document's score is a logistic
function of what its marginals add up to.
"""

from __future__ import annotations

import heapq
import pickle
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width

_TOKEN = re.compile(r"[^\W\d_]+")
REACH = 8  # clean tokens kept on each side of a token with evidence
PLAIN = 3  # stretches of a document without signs that the fit sees
MOST_CACHED = 150_000


def features(word: str) -> list[str]:
    """The word itself, its first 3 to 8 letters, its last 3 and 4."""
    return ["w" + word, *("p" + word[:k] for k in range(3, 9) if len(word) > k), *("s" + word[-k:] for k in (3, 4) if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    transition: np.ndarray
    logistic: np.ndarray
    evidence: float = -3.0
    cache: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> float:
        """How much likelier, in log odds, the toxic state emits this token than the clean one."""
        got = self.cache.get(word)
        if got is None:
            w = self.weights
            got = self.bias + sum(w.get(f, 0.0) for f in features(word.lower()))
            if len(self.cache) >= MOST_CACHED:
                self.cache.clear()
            self.cache[word] = got
        return got


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For many chains laid out one below the other, padded to one width: P(toxic) of every
    token, and the expected number of neighbours in each pair of states.
    """
    n, width = emissions.shape
    live = np.arange(width) < lengths[:, None]
    t = transition

    def step(prev: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.stack([np.logaddexp(prev[:, 0] + a[0, 0], prev[:, 1] + a[1, 0]), np.logaddexp(prev[:, 0] + a[0, 1], prev[:, 1] + a[1, 1])], 1)

    fwd, bwd = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    e = np.stack([np.zeros_like(emissions), emissions], 2)
    if width:
        fwd[:, 0] = e[:, 0]
    for i in range(1, width):
        fwd[:, i] = np.where(live[:, i, None], step(fwd[:, i - 1], t) + e[:, i], fwd[:, i - 1])
    for i in range(width - 2, -1, -1):
        bwd[:, i] = np.where(live[:, i + 1, None], step(bwd[:, i + 1] + e[:, i + 1], t.T), bwd[:, i + 1])
    total = fwd + bwd
    pair = np.zeros((2, 2))
    if width > 1:
        norm = np.logaddexp(total[:, :1, 0], total[:, :1, 1])
        for a in (0, 1):
            for b in (0, 1):
                pair[a, b] = np.exp(fwd[:, :-1, a] + t[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - norm)[live[:, 1:]].sum()
    return np.where(live, 1 / (1 + np.exp(np.clip(total[..., 0] - total[..., 1], -60, 60))), 0.0), pair


def islands(e: np.ndarray, doc_stops: np.ndarray, evidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (first, stop) of tokens within REACH of one with evidence, inside one document each.

    Between such stretches the chain is in the clean state all but surely, so each stretch is
    a chain of its own; tokens outside count as clean.
    """
    hot = np.flatnonzero(e > evidence)
    if not len(hot):
        return hot, hot
    doc = np.searchsorted(doc_stops, hot, "right")
    lo = np.maximum(hot - REACH, np.concatenate([[0], doc_stops])[doc])
    hi = np.minimum(hot + REACH + 1, doc_stops[doc])
    new = np.concatenate([[True], (lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(hot)) - 1]


def token_marginals(e: np.ndarray, doc_stops: np.ndarray, model: Model) -> np.ndarray:
    """P(toxic) of every token of many documents."""
    p = np.zeros(len(e))
    lo, hi = islands(e, doc_stops, model.evidence)
    order = np.argsort(hi - lo, kind="stable")
    for k in range(0, len(order), 512):
        part = order[k : k + 512]
        length = hi[part] - lo[part]
        spots = lo[part][:, None] + np.arange(length.max())
        live = np.arange(length.max()) < length[:, None]
        p[spots[live]] = forward_backward(np.where(live, e[np.minimum(spots, len(e) - 1)], 0.0), length, model.transition)[0][live]
    return p


def summary(p: np.ndarray, doc_stops: np.ndarray) -> np.ndarray:
    """For each document: expected toxic tokens (at most 6), and the chance of at least one and of at least two."""
    edges = np.concatenate([[0], doc_stops])
    q = np.clip(p, 0, 1 - 1e-9)
    logs, odds, sums = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.log1p(-q), q / (1 - q), p))
    take = lambda c: c[edges[1:]] - c[edges[:-1]]
    none = np.exp(np.minimum(take(logs), 0))
    one = np.minimum(none * np.maximum(take(odds), 0), 1 - none)
    return np.stack([np.minimum(take(sums), 6), 1 - none, 1 - none - one, np.ones(len(doc_stops))], 1)


def least_runs(tokens: list[str], size: int = 16, run: int = 3) -> list[int]:
    """The least hashes of a text's distinct runs of ``run`` words, ascending."""
    runs = {" ".join(tokens[i : i + run]) for i in range(max(1, len(tokens) - run + 1))} if tokens else ()
    return heapq.nsmallest(size, {zlib.crc32(w.encode()) * 0x9E3779B1 % 2**32 for w in runs})


def distinct_families(runs: list[list[int]], shared: int = 5) -> list[int]:
    """The places of one document of each family of copies: those that share few of their least runs with any before.

    A sample drawn from a corpus with copies would else take a copied document's chance words
    for signs of its label. Runs of words tell copies from documents that only have their
    vocabulary in common.
    """
    posted: dict[int, list[int]] = {}
    out: list[int] = []
    for k, least in enumerate(runs):
        met = Counter(i for h in least for i in posted.get(h, ()))
        if least and met and met.most_common(1)[0][1] >= min(shared, len(least)):
            continue
        for h in least:
            posted.setdefault(h, []).append(k)
        out.append(k)
    return out


def signs(rows: list[tuple[list[str], bool]], least_lift: float = 2.5, margin: float = 8.0) -> tuple[set[str], set[str]]:
    """Features surely likelier in toxic documents, and all frequent ones; ``rows`` are documents' distinct words and labels.

    Sure is a lift of ``least_lift`` (in logarithms) and a log-likelihood ratio that chance
    reaches for none of as many features as are tried, with a margin.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    size = [0, 0]
    for words, toxic in rows:
        size[toxic] += 1
        seen[toxic].update({f for w in words for f in features(w)})
    seeds = set()
    if all(size):
        least_g = margin + 2 * np.log(max(2, len(seen[0].keys() | seen[1].keys())))
        for f, c1 in seen[1].items():
            c0 = seen[0][f]
            lift = np.log((c1 + 0.5) / (size[1] + 1)) - np.log((c0 + 0.5) / (size[0] + 1))
            mean = (c0 + c1) / sum(size)
            g = 2 * (c1 * np.log(c1 / (size[1] * mean)) + (c0 * np.log(c0 / (size[0] * mean)) if c0 else 0))
            if lift >= least_lift and g >= least_g:
                seeds.add(f)
    return seeds, {f for s in seen for f, c in s.items() if c >= 6}


Chain = tuple[list[str], list[int]]


def chains_of(tokens: list[str], toxic: bool, seeds: set[str], most: int) -> list[Chain]:
    """Stretches of a text (words, marks) for the fit: about its words with signs, or about evenly spaced ones where it has none.

    At most ``most`` of either, drawn evenly from all over the text.
    """
    known = {w: any(f in seeds for f in features(w)) for w in set(tokens)}
    hits = [i for i, w in enumerate(tokens) if known[w]] or [int(x) for x in np.linspace(0, len(tokens) - 1, PLAIN)] * bool(tokens)
    spots = [hits[int(x)] for x in np.linspace(0, len(hits) - 1, most)] if len(hits) > most else hits
    out = []
    for i in spots:
        a, b = max(0, i - REACH), min(len(tokens), i + REACH + 1)
        out.append((tokens[a:b], [int(toxic and known[w]) for w in tokens[a:b]]))
    return out


def fit_field(chains: list[Chain], kept: set[str], rounds: int = 80) -> tuple[dict[str, float], float, np.ndarray]:
    """Weights, bias and transitions from labelled stretches."""
    index = {f: i for i, f in enumerate(sorted(kept))}
    width = 2 * REACH + 1
    length = np.array([len(c) for c, _ in chains])
    live = np.arange(width) < length[:, None]
    y = np.zeros((len(chains), width))
    flat, spot = array("i"), array("i")  # millions of entries: plain lists of them would fill the driver
    for r, (tokens, marks) in enumerate(chains):
        y[r, : len(marks)] = marks
        for j, w in enumerate(tokens):
            for f in features(w):
                if f in index:
                    flat.append(index[f])
                    spot.append(r * width + j)
    cols, cells = (np.frombuffer(x, np.int32).astype(np.int64) for x in (flat, spot))
    w, bias, t = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    gw, gb, gt = np.full(len(index), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    both = live[:, 1:] & live[:, :-1]
    have = np.array([[((1 - y[:, :-1]) * (1 - y[:, 1:]))[both].sum(), ((1 - y[:, :-1]) * y[:, 1:])[both].sum()], [(y[:, :-1] * (1 - y[:, 1:]))[both].sum(), (y[:, :-1] * y[:, 1:])[both].sum()]])
    n = len(chains)
    for _ in range(rounds):
        e = np.where(live, (bias + np.bincount(cells, w[cols], minlength=n * width)).reshape(n, width), 0.0)
        p, pair = forward_backward(e, length, t)
        miss = np.where(live, y - p, 0.0)
        dw = np.bincount(cols, miss.ravel()[cells], minlength=len(w)) / n - 1e-5 * w
        db = miss.sum() / n
        dt = (have - pair) / n - 1e-3 * t
        gw, gb, gt = gw + dw * dw, gb + db * db, gt + dt * dt
        w, bias, t = w + 0.5 * dw / np.sqrt(gw), bias + 0.5 * db / np.sqrt(gb), t + 0.1 * dt / np.sqrt(gt)
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(bias), t


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.05 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        b = b + np.linalg.solve(hess, grad)
    return b


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, chains: int = 12) -> Model:
    """Fits a model on at most ``sample`` labelled documents, half of each class where there are as many.

    Only rows with crc32(doc_id as text) mod 4 other than 2 are drawn; which of them depends
    on a hash of the id. A document gives at most ``chains`` stretches of 2 * REACH + 1 words to
    the fit, drawn evenly from all of it, PLAIN where it has no signs. Texts are read where they
    lie: the driver gets the documents' distinct words, the stretches, and four sums of each.
    The classes' shares among all such rows set the score's level. Without any labelled row of
    either class every document gets one constant score.
    """
    spark = docs.sparkSession
    open_rows = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in open_rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = {k: [r[0] for r in open_rows.where(F.col("toxic") == k).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2).collect()] for k in (0, 1)}
    marks = {d: k for k, ids in chosen.items() for d in ids}
    level = np.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 0.5))
    constant = Model({}, -6.0, np.zeros((2, 2)), np.array([0, 0, 0, level]))
    if not marks:
        return constant
    ids = spark.createDataFrame(list(marks.items()), "id long, toxic int")  # no more than ``sample`` rows
    drawn = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "toxic", "text")
    drawn = Scratch(spark).keep(drawn, "sample").repartition(shuffle_width(spark), "id")

    def each(make: Callable[[list[str], bool], bytes]) -> list[tuple[int, bool, bytes]]:
        """What ``make`` gives of every drawn text's lower-case words, by id."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                toxic = batch["toxic"].to_pylist()
                made = [make([w.lower() for w in _TOKEN.findall(t or "")], bool(k)) for t, k in zip(batch["text"].to_pylist(), toxic, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["toxic"], pa.array(made, pa.binary())], names=["id", "toxic", "made"])

        return sorted((r["id"], bool(r["toxic"]), bytes(r["made"])) for r in drawn.mapInArrow(run, "id long, toxic int, made binary").collect())

    seen = [(k, *pickle.loads(x)) for _, k, x in each(lambda ws, _: pickle.dumps((least_runs(ws), " ".join(sorted(set(ws))))))]
    first = distinct_families([runs for _, runs, _ in seen])
    seeds, kept = signs([([sys.intern(w) for w in seen[i][2].split()], seen[i][0]) for i in first])
    del seen
    if not seeds:
        return constant
    families = set(first)
    cut = each(lambda ws, k: pickle.dumps(chains_of(ws, k, seeds, chains)))
    stretches = [c for i, (_, _, x) in enumerate(cut) if i in families for c in pickle.loads(x)]
    model = Model(*fit_field(stretches, kept), np.zeros(4))
    del cut, stretches

    def sums(words: list[str], _: bool) -> bytes:
        e = np.array([model.emission(w) for w in words], dtype=float)
        stops = np.array([len(words)])
        return summary(token_marginals(e, stops, model), stops)[0].tobytes()

    got = each(sums)
    x, y = np.array([np.frombuffer(v) for *_, v in got]), np.array([float(k) for _, k, _ in got])
    if not y.any() or y.all():
        return constant
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
    model.logistic = _fit_logistic(x, y, weight * len(y) / weight.sum())
    return model


PART = 400  # documents scored at a time


def score_texts(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts, P(toxic) of all their tokens one after the other, and where each text's tokens stop."""
    words = [_TOKEN.findall(t) for t in texts]
    stops = np.cumsum([len(w) for w in words])
    have, emit = model.cache.get, model.emission
    got: list[float] = []
    for ws in words:
        got += [emit(w) if x is None else x for w, x in zip(ws, map(have, ws), strict=True)]
    p = token_marginals(np.array(got, dtype=float), stops, model)
    return 1 / (1 + np.exp(-np.clip(summary(p, stops) @ model.logistic, -30, 30))), p, stops


SPAN = "array<struct<start:int,stop:int,p:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", span_p: float = 0.5) -> DataFrame:
    """``docs`` as doc_id, score and toxic_spans (code point offsets of runs of tokens with P(toxic) of ``span_p`` or more).

    A null or empty text has no tokens and gets the score of a text without evidence; every
    token of a long text is read. Rows are scored one by one, repeated rows alike.
    """
    out = f"doc_id long, score double, toxic_spans {SPAN}"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[1].to_pylist()
            for k in range(0, len(texts), PART):
                part = [t or "" for t in texts[k : k + PART]]
                s, p, stops = score_texts(part, model)
                spans: list[list[dict]] = []
                for t, a, b in zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    found: list[dict] = []
                    if b > a and (p[a:b] >= span_p).any():
                        last = -2
                        for i, m in enumerate(_TOKEN.finditer(t)):
                            if p[a + i] >= span_p:
                                if last == i - 1:
                                    found[-1] |= {"stop": m.end(), "p": max(found[-1]["p"], p[a + i])}
                                else:
                                    found.append({"start": m.start(), "stop": m.end(), "p": p[a + i]})
                                last = i
                    spans.append(found)
                yield pa.RecordBatch.from_arrays([batch[0].slice(k, len(part)).cast(pa.int64()), pa.array(s), pa.array(spans, kind)], names=["doc_id", "score", "toxic_spans"])

    return docs.select(id_col, text_col).mapInArrow(run, out)


def without_toxic(docs: DataFrame, model: Model, at: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``at`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch[text_col].to_pylist()]
            for k in range(0, len(texts), PART):
                yield batch.slice(k, PART).filter(pa.array(score_texts(texts[k : k + PART], model)[0] < at))

    return docs.mapInArrow(run, docs.schema)
