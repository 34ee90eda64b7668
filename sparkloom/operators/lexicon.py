"""Terms of a table in texts: an automaton over many terms, walked once over each text.

Terms come as rows. They are packed by Spark into slices of about SLICE bytes; each slice is an
automaton that a worker builds once and walks over its Arrow batches, so a text costs the same
whatever the number of terms in the slice. A lexicon of several slices takes a walk for each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 32 << 20  # bytes of terms in one automaton
BATCH = 20_000  # hits sent on at a time
_built: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, terms: list[tuple[str, list]]) -> ahocorasick.Automaton:
    """The automaton of a slice; a worker keeps the last one it has built."""
    if name not in _built:
        _built.clear()
        own = ahocorasick.Automaton()
        for term, ids in terms:
            own.add_word(term, (len(term), ids))
        own.make_automaton()
        _built[name] = own
    return _built[name]


def slices(lexicon: DataFrame, term: str, term_id: str) -> list[list[tuple[str, list]]]:
    """Distinct non-empty terms, each with the ids that have it, in slices of about SLICE bytes. The driver holds the lexicon once."""
    own = lexicon.where(F.length(term) > 0).groupBy(F.col(term).alias("t")).agg(F.array_sort(F.collect_set(term_id)).alias("ids"))
    out: list[list[tuple[str, list]]] = []
    size = SLICE
    for row in own.orderBy("t").toLocalIterator():
        if size >= SLICE:
            out.append([])
            size = 0
        out[-1].append((row["t"], row["ids"]))
        size += len(row["t"].encode()) + 16
    return out


def places(own: ahocorasick.Automaton, batches: Iterator[pa.RecordBatch], term_id: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The batches' first column, ids, starts and stops of all places in their second; 128 texts are held as Python's, and no more than BATCH places."""
    for batch in batches:
        at, ids, starts, stops = [], [], [], []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([batch[0].take(pa.array(at, pa.int32())), pa.array(ids, kind), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=[batch.schema.names[0], term_id, "start", "stop"])  # noqa: B023
            for x in (at, ids, starts, stops):  # noqa: B023
                x.clear()
            return out

        for i, t in enumerate(text for few in range(0, batch.num_rows, 128) for text in batch[1].slice(few, 128).to_pylist()):
            for last, (n, mine) in own.iter(t or ""):
                for v in mine:
                    at.append(i)
                    ids.append(v)
                    starts.append(last + 1 - n)
                    stops.append(last + 1)
                    if len(at) >= BATCH:
                        yield full()
        if at:
            yield full()


def hits(rows: DataFrame, key: str, text: str, lexicon: DataFrame, term: str = "term", term_id: str = "term_id") -> DataFrame:
    """``key``, ``term_id``, start and stop (code points, stop exclusive) of every place of every term, overlapping ones included.

    Letters count as they are: fold both sides before for any case. Null and empty texts and
    terms have no places; ids that share a term have a row each; rows that repeat a key are
    walked each for itself.
    """
    spark = rows.sparkSession
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((rows, key), (lexicon, term_id))}
    schema = f"`{key}` {kinds[key]}, `{term_id}` {kinds[term_id]}, start int, stop int"
    arrow = spark.createDataFrame([], lexicon.select(term_id).schema).toArrow().schema.field(0).type

    def walk(part: list[tuple[str, list]]) -> DataFrame:
        name, held = uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(part))  # about SLICE bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return places(automaton(name, pickle.loads(held.value)), batches, term_id, arrow)

        return rows.select(key, text).mapInArrow(run, schema)

    found = [walk(part) for part in slices(lexicon, term, term_id)]
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mutual_substring(mentions: DataFrame, name: str, table: DataFrame, other: str) -> DataFrame:
    """Pairs, all columns of both, in which either name holds the other; an empty name is held by all that aren't null.

    The table's names are walked over the mentions' distinct names; that a mention lies in one of
    them is an equality with one of its parts. So the work follows the names and the pairs found.
    """
    names = mentions.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    others = table.where(F.col(other).isNotNull()).select(F.col(other).alias("_other")).distinct()
    held = hits(names, "_name", "_name", others, "_other", "_other").select("_name", "_other")
    n = F.length("_other")
    spots = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("_other"), i, k)))
    holds = others.where("_other <> ''").select("_other", F.explode(F.array_distinct(F.flatten(spots))).alias("_name")).join(names, "_name").select("_name", "_other")
    # an empty name is no term; it is one row beside the other side's distinct ones
    empty = names.where("_name = ''").join(others).unionByName(names.join(others.where("_other = ''")))
    pairs = held.unionByName(holds).unionByName(empty).distinct()
    return mentions.join(pairs, F.col(name) == F.col("_name")).join(table, F.col(other) == F.col("_other")).drop("_name", "_other")


def weighed(rows: DataFrame, key: str, text: str, lexicon: DataFrame, term: str = "term", weight: str = "weight") -> DataFrame:
    """``key``, weight, n_terms: the sum over the distinct terms of a lexicon that a text holds in any letter case; rows without any are left out."""
    low = lexicon.groupBy(F.lower(term).alias("term")).agg(F.max(weight).alias("weight"))
    found = hits(rows.select(key, F.lower(text).alias("_text")), key, "_text", low, "term", "term").select(key, "term").distinct()
    return found.join(low, "term").groupBy(key).agg(F.sum("weight").alias("weight"), F.count("*").alias("n_terms"))


def longest_literal(glob: Column) -> Column:
    """The longest part of a glob between its stars, lower-cased; empty for stars alone."""
    parts = F.split(F.lower(glob), "\\*")
    return F.element_at(F.array_sort(parts, lambda a, b: F.when(F.length(a) < F.length(b), -1).when(F.length(a) > F.length(b), 1).otherwise(0)), -1)


def glob_matches(rows: DataFrame, key: str, text: str, globs: DataFrame, glob: str = "glob") -> DataFrame:
    """``key`` and the columns of ``globs`` for each glob that matches a whole text, or its beginning, in any letter case.

    The only wildcard is the star. A glob is tried where its longest literal occurs; globs of
    stars alone match every text that isn't null.
    """
    pattern = F.concat(F.lit("(?is)^"), F.replace(F.regexp_replace(glob, r"([.+?^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))
    own = globs.withColumn("_literal", longest_literal(F.col(glob))).withColumn("_pattern", pattern)
    texts = rows.select(key, F.col(text).alias("_text"), F.lower(text).alias("_low"))
    tried = hits(texts, key, "_low", own.where("_literal <> ''"), "_literal", "_literal").select(key, "_literal").distinct()
    some = tried.join(own, "_literal").join(texts, key).where(F.expr("_text rlike _pattern"))
    every = texts.where("_text is not null").join(own.where("_literal = ''"))  # all of these pairs match
    return some.select(key, *globs.columns).unionByName(every.select(key, *globs.columns))
