"""MinHash near-duplicate detection by an inverted join on signature coordinates.

Every distinct shingle set gets a signature of ``coordinates`` minima. Each (coordinate,
value) pair is a posting list. A pair of similar sets agrees on at least ``least`` coordinates
(all but one in a thousand million pairs at the link threshold do), so of each set's pairs,
from the rarest to the most frequent, all but the last least-1 suffice to meet it: those
prefixes are posted, the most frequent lists are skipped. Members of one list are merged by
counting the coordinates on which their signatures agree; sets that agree often enough make
candidate families. Within a family links are confirmed on the full shingle sets, and linked
sets make components. Sets in long lists are first linked, confirmed, to the first set of their
list; what is so known to belong together is not compared again, so thousands of near copies cost
about as much as they are many. The others meet in pairs of blocks, so no task holds a whole
family; tasks return spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, components, roots
from .textvec import U64, chunks, mix, prefix_sums, span_hash, words

COORDINATES = 64
MISS = 1e-9
LIST_BLOCK = 512
FAMILY_BLOCK = 256
FAMILY_SHINGLES = 400_000  # a family's blocks hold about so many shingles at most
FEW = 12  # sets in a list that are compared with those of other lists at once
STAR = 256  # sets compared with one head in a task


@cache
def least_matches(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t for which a pair at the threshold agrees on fewer than t coordinates with at most probability ``miss``."""
    p, total, t = (1 - threshold) ** coordinates, 0.0, 0
    while total + p <= miss:
        total += p
        p *= (coordinates - t) / (t + 1) * threshold / (1 - threshold)
        t += 1
    return max(1, t)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of many documents as hashes, ascending within each, and where each document's begin.

    A-Z are lower-cased. A document of fewer than ``size`` words has its whole sequence as
    one shingle, one without words none.
    """
    h, _, _, bounds = words(data, offsets, lower=True)
    sums = prefix_sums(h)
    n = np.diff(bounds)
    out, at = [], [0]
    start = np.arange(max(0, len(h) - size + 1))
    whole = span_hash(sums, start, start + size) if len(start) else np.zeros(0, np.uint64)
    for i, k in zip(bounds[:-1].tolist(), n.tolist(), strict=True):
        if k >= size:
            got = np.unique(whole[i : i + k - size + 1])
        elif k:
            got = span_hash(sums, np.array([i]), np.array([i + k]))
        else:
            got = np.zeros(0, np.uint64)
        out.append(got)
        at.append(at[-1] + len(got))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(at, np.int64)


def set_hashes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(s)))]) for s in (0x1234567, 0x7654321)]
    h1, h2 = ((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64) for c in sums)
    return h1, h2


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of COORDINATES multiply-shift hashes over each non-empty set, as unsigned 32-bit numbers."""
    keys = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F))
    have = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    if len(have):
        for k in range(COORDINATES):
            h = values * (keys[k] | U64(1)) + keys[COORDINATES + k]
            h >>= U64(32)
            out[have, k] = np.minimum.reduceat(h, bounds[have])
    return out


_SCAN = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def scan(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Each document's set size, two hashes of its set, and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, off, data in chunks(batch[0], batch[1], 1 << 19):
                v, at = shingle_sets(off, data, size)
                n = np.diff(at)
                h1, h2 = set_hashes(v, at)
                sig = signatures(v, at)
                yield pa.RecordBatch.from_arrays(
                    [batch[0].slice(int(rows[0]), len(rows)).cast(pa.int64()), pa.array(n), pa.array(h1), pa.array(h2), pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary())],
                    names=[c.split()[0] for c in _SCAN.split(", ")],
                )

    return docs.select(id_col, text_col).mapInArrow(run, _SCAN)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[i] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows or more that hold runs of equal keys as a whole, from batches sorted by them, with where each run begins (and the end)."""
    held: list[pa.RecordBatch] = []
    many = 0

    def starts(t: pa.Table) -> np.ndarray:
        cols = [t[k].to_numpy() for k in keys]
        return np.append(np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])), t.num_rows)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            many += batch.num_rows
        if many >= rows:
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 2:
                yield t.slice(0, at[-2]), at[:-1]
                held = t.slice(at[-2]).to_batches()
                many = t.num_rows - int(at[-2])
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def in_block_pairs(df: DataFrame, key: str, blocks: Column, member: str) -> DataFrame:
    """``df`` with bi, bj, mine: each row once for every pair of blocks of its group that its own block is in.

    ``blocks`` is the number of blocks of the row's group. A group of one block has the pair (0, 0).
    """
    own = F.pmod(F.xxhash64(member, F.lit(5)), blocks).cast("int")
    rows = df.withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return rows.select(*df.columns, F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine")


def against_others(df: DataFrame, key: str, known: str, member: str, most: int, volume: str | None = None, most_volume: int = 1) -> DataFrame:
    """``df`` with bi and bj: rows of a group so dealt that any two which aren't known to belong together meet.

    ``known`` names the component that a row is known to be in. A group's largest known
    component never meets itself: its blocks only meet those of the others, so a group that is
    one component costs nothing and one that is nearly so costs what its few others cost.
    Groups that are one component go.
    """
    size = F.sum(volume) if volume else F.lit(0).cast("long")
    parts = df.groupBy(key, known).agg(F.count("*").alias("n"), size.alias("v"))
    most_of = F.struct("n", F.col(known).alias("c"), "v")
    stat = parts.groupBy(key).agg(F.max(most_of).alias("top"), F.sum("n").alias("n"), F.sum("v").alias("v")).where(F.col("n") > F.col("top.n"))
    cut = lambda n, v: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(v / most_volume)).cast("int")
    stat = stat.select(key, F.col("top.c").alias("_top"), cut(F.col("n") - F.col("top.n"), F.col("v") - F.col("top.v")).alias("_few"), cut(F.col("top.n"), F.col("top.v")).alias("_many"))
    rows = df.join(stat, key)
    top = F.col(known) == F.col("_top")
    spot = F.xxhash64(member, F.lit(5))
    own = F.when(top, F.col("_few") + F.pmod(spot, F.col("_many"))).otherwise(F.pmod(spot, F.col("_few"))).cast("int")
    other = F.sequence(F.lit(0), F.when(top, F.col("_few") - 1).otherwise(F.col("_few") + F.col("_many") - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(other))
    return rows.select(*df.columns, F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"))


_EDGES = "a long, b long"


def _forest(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[moved], ids[label[moved]]


def posted_lists(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, token, df: each set's posting lists (coordinate and value) that another set shares, with their lengths."""
    coords = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
    values = F.transform(coords, lambda c: F.xxhash64(c, F.substring(F.col("sig"), c * 4 + 1, F.lit(4))))
    tokens = sets.select("rep", F.explode(values).alias("token"))
    lengths = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return scratch.keep(tokens.join(lengths, "token"), "met")


def low_bytes() -> Column:
    """The low bytes of a signature's coordinates, one after the other."""
    low = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda c: F.hex(F.substring(F.col("sig"), c * 4 + 1, F.lit(1))))
    return F.unhex(F.array_join(low, ""))


def _lows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def star_edges(docs: DataFrame, met: DataFrame, sets: DataFrame, wanted: Shingles, least: int, scratch: Scratch) -> DataFrame:
    """Edges a, b that link sets in long lists to the first set of the same list, confirmed on full shingle sets.

    Near copies by the thousand share their lists; so linked, they are one known component
    before any two of them are compared. Each set takes the two longest of its long lists, and
    its full set travels only if its signature agrees with the first set's often enough.
    """
    longest = F.slice(F.sort_array(F.collect_list(F.struct("df", "token")), asc=False), 1, 2)
    own = met.where(F.col("df") > LIST_BLOCK).groupBy("rep").agg(longest.alias("l")).select("rep", F.explode("l.token").alias("token"))
    heads = own.groupBy("token").agg(F.min("rep").alias("head"))
    lows = sets.select(F.col("rep").alias("_rep"), "low")
    pairs = own.join(heads, "token").where("rep <> head").select("rep", "head").distinct()
    both = pairs.join(lows, F.col("rep") == F.col("_rep")).drop("_rep").withColumnRenamed("low", "own").join(lows, F.col("head") == F.col("_rep")).select("rep", "head", "own", "low")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["rep", "head"]).filter(pa.array((_lows(batch["own"]) == _lows(batch["low"])).sum(1) >= least))

    pairs = scratch.keep(both.mapInArrow(alike, "rep long, head long"), "star-pairs")
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    spokes = pairs.join(parts, "head").select("rep", "head", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("bi"), F.lit(1).alias("spoke"))
    hubs = parts.select(F.col("head").alias("rep"), "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("bi"), F.lit(0).alias("spoke"))
    dealt = wanted.of(docs, spokes.unionByName(hubs).join(sets.select("rep", "h1", "h2"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: np.ndarray | None = None
        head = None
        for batch in batches:
            ids, heads_, kinds = (batch[c].to_numpy() for c in ("rep", "head", "spoke"))
            hit = []
            for i, raw in enumerate(batch["shingles"].to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                if not kinds[i]:
                    hub, head = own, heads_[i]
                elif head == heads_[i]:
                    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                    common = int((hub[at] == own).sum())
                    if common and 100 * common >= wanted.percent * (len(hub) + len(own) - common):
                        hit.append(i)
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(heads_[hit])], names=["a", "b"])

    return dealt.repartition("head", "bi").sortWithinPartitions("head", "bi", "spoke").mapInArrow(run, _EDGES)


@dataclass(frozen=True)
class Shingles:
    """How full shingle sets are made again from the texts of some rows."""

    id_col: str
    text_col: str
    size: int
    percent: int

    def of(self, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` (rep, h1, h2 and others) with shingles: the sets of these documents, of rows that repeat an id the one with these hashes."""
        names = [c for c in rows.columns if c not in ("h1", "h2")]
        texts = docs.select(F.col(self.id_col).alias("_id"), F.col(self.text_col).alias("text"))
        # the rows grow with the corpus: the plan that holds at scale is taken at every size
        both = texts.join(rows.hint("merge"), texts["_id"] == rows["rep"]).select("text", "h1", "h2", *names)
        schema = StructType([*(rows.schema[c] for c in names), StructField("shingles", BinaryType())])

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, off, data in chunks(batch[0], batch[0], 1 << 19):
                    v, at = shingle_sets(off, data, self.size)
                    part = batch.slice(int(own[0]), len(own))
                    h1, h2 = set_hashes(v, at)
                    mine = (h1 == part["h1"].to_numpy()) & (h2 == part["h2"].to_numpy())
                    out = [*part.select(names).columns, pa.array([v[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, names=[*names, "shingles"]).filter(pa.array(mine))

        return both.mapInArrow(sets, schema)


def candidate_edges(sets: DataFrame, met: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Edges a, b between known components that hold sets whose signatures agree on at least ``least`` coordinates.

    ``sets`` has rep long, low binary and known long. The signatures' low bytes are compared;
    chance agreement of bytes only adds candidates.
    """
    # per set: its lists from the longest; the first least-1 of them need not be posted
    posted = met.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token")), asc=False).alias("lists")).where(F.size("lists") >= least)
    posted = posted.select("rep", F.inline(F.slice("lists", least, COORDINATES))).select("rep", "token")
    posted = posted.join(sets.select("rep", "known", "low"), "rep")
    order = ["token", "bi", "bj"]
    dealt = against_others(scratch.keep(posted, "posted"), "token", "known", "rep", LIST_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, order):
            known, low, size = t["known"].to_numpy(), _lows(t["low"]), np.diff(at)
            x, y = [], []
            # lists of a few: all of them together, by the distance of the two in the list
            few = np.repeat((size <= FEW) & (size > 1), size)
            end = np.repeat(at[1:], size)
            for d in range(1, min(FEW, int(size.max()))):
                i = np.flatnonzero(few[:-d] & (np.arange(len(few) - d) + d < end[:-d]))
                i = i[known[i] != known[i + d]]
                i = i[(low[i] == low[i + d]).sum(1) >= least]
                x.append(known[i])
                y.append(known[i + d])
            # longer ones: each set outside the commonest known component against all others
            for g in np.flatnonzero(size > FEW).tolist():
                a, z = at[g], at[g + 1]
                names, own, many = np.unique(known[a:z], return_inverse=True, return_counts=True)
                top = int(many.argmax())
                met_ = low[a:z]
                for i in np.flatnonzero(own != top).tolist():
                    rest = np.flatnonzero((own != own[i]) & ((own == top) | (np.arange(z - a) > i)))
                    hit = rest[(met_[rest] == met_[i]).sum(1) >= least]
                    other = np.unique(own[hit])
                    x.append(np.full(len(other), names[own[i]]))
                    y.append(names[other])
            x, y = np.concatenate(x) if x else np.zeros(0, np.int64), np.concatenate(y) if y else np.zeros(0, np.int64)
            if len(x):
                names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
                a, b = _forest(names, roots(len(names), ends[: len(x)], ends[len(x) :]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, _EDGES)


def confirmed_edges(docs: DataFrame, families: DataFrame, wanted: Shingles) -> DataFrame:
    """Edges a, b that span what links of 100 * intersection >= percent * union connect inside each family.

    ``families`` has rep, family, known, n_shingles, h1 and h2. Sets are dealt before they are
    made, so what is known to belong together is neither copied nor compared.
    """
    dealt = against_others(families, "family", "known", "rep", FAMILY_BLOCK, "n_shingles", FAMILY_SHINGLES).drop("n_shingles", "known")
    order = ["family", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, order):
            if g.num_rows < 2:
                continue
            ids, first = np.unique(g["rep"].to_numpy(), return_index=True)
            raw = g["shingles"].to_pylist()
            got = [np.frombuffer(raw[i], np.uint64) for i in first.tolist()]
            x, y = linked_pairs(got, wanted.percent)
            a, b = _forest(ids, roots(len(ids), x, y))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return wanted.of(docs, dealt).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, _EDGES)


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with 100 * intersection >= percent * union, by their positions; empty sets link with nothing."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        i = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = 100 * i >= percent * (n.sum() - i) and i
        return (np.array([0]), np.array([1])) if ok else (np.zeros(0, int), np.zeros(0, int))
    both = np.concatenate(sets)
    code, count = np.unique(both, return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[code] > 1
    order = np.argsort(code[shared], kind="stable")
    row, code = row[shared][order], code[shared][order]
    code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    inter = np.zeros((len(sets), len(sets)), np.float64)
    width = max(1, 8_000_000 // len(sets))
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, [c, c + width])
        m = np.zeros((len(sets), min(width, int(code[j - 1]) - c + 1)), np.float32)
        m[row[i:j], code[i:j] - c] = 1
        inter += m @ m.T
    union = n[:, None] + n[None, :] - inter
    x, y = np.nonzero(np.triu((100 * inter >= percent * union) & (inter > 0), 1))
    return x, y


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id).

    Documents are linked when their word shingle sets have a Jaccard likeness of at least
    ``percent`` in a hundred. A null or empty text, or one without words, has no shingles and
    stays alone. Rows with a null id take no part: null component, kept. Rows that repeat an
    id share its component; only the first text of an id, by its set's hash, stands for it.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.keep(scan(docs, id_col, text_col, size), "scan")
    full = scanned.where("doc_id is not null and n_shingles > 0")
    key = ["h1", "h2", "n_shingles"]
    classes = scratch.keep(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
    one = F.min_by(F.struct("sig", "n_shingles", "h1", "h2"), F.struct("h1", "h2", "n_shingles"))  # of rows that repeat an id
    sets = scratch.keep(classes.groupBy("rep").agg(one.alias("r")).select("rep", "r.*").withColumn("low", low_bytes()), "sets")
    wanted, least = Shingles(id_col, text_col, size, percent), least_matches(percent / 100)
    met = posted_lists(sets, scratch)
    stars = scratch.keep(star_edges(docs, met, sets, wanted, least, scratch), "stars")
    known = components(stars, scratch, "known")
    sets = scratch.keep(sets.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("known", F.coalesce("root", "rep")).drop("root", "sig"), "known-sets")
    near = components(candidate_edges(sets, met, scratch, least), scratch, "families")
    families = sets.join(near.select(F.col("node").alias("known"), F.col("root").alias("family")), "known").select("rep", "family", "known", "n_shingles", "h1", "h2")
    links = scratch.keep(confirmed_edges(docs, scratch.keep(families, "members"), wanted), "edges")
    found = components(links.unionByName(stars), scratch, "links")
    first = found.groupBy("root").agg(F.min("node").alias("component"))
    found = scratch.keep(found.join(first, "root").select(F.col("node").alias("rep"), "component"), "components")
    named = scratch.keep(classes.drop("sig").join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component")), "named")
    out = scanned.drop("sig").join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate component: the one with the least id. Rows with a null id stay."""
    found = near_duplicates(docs, size, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    found = Scratch(docs.sparkSession).keep(found, "kept")
    return docs.join(found.hint("merge"), docs[id_col] == found["kept_id"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
