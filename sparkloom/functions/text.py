"""Text measures as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no role information.
STOPWORDS = (
    "a an the and or but if of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once is are was were be been being have has had do does did will would should could can may "
    "might must shall we you they it this that these those as such our your their its"
).split()


def without_suffix(w: Column) -> Column:
    """One of the endings ing (with four letters or more left), ies (to y), es, s (not ss) is taken off, the first that fits."""
    n = F.length(w)
    return (
        F.when(w.endswith("ing") & (n > 6), F.substring(w, F.lit(1), n - 3))
        .when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(w.endswith("es") & (n > 4), F.substring(w, F.lit(1), n - 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def role_keywords(text: Column) -> Column:
    """Distinct lower-case keywords of three letters or more, without stop words, each by its stem."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z][a-zA-Z-]*)"), F.lit(1))
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, without_suffix))


def overlap_coefficient(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def syllables(word: Column) -> Column:
    """Vowel groups of the word's a-z letters, less a final e where more than one; 1 at least, 0 without letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(F.length(w) == 0, 0).otherwise(F.greatest(F.lit(1), groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-zA-Z]+)"), F.lit(1))


def sentence_count(text: Column) -> Column:
    parts = F.filter(F.split(text, "[.!?]+\\s+"), lambda s: F.length(F.trim(s)) > 0)
    return F.greatest(F.lit(1), F.size(parts))


def syllable_sums(text: Column) -> Column:
    """n, total and hard: a text's words, their syllables, and those with three or more, in one pass over its words."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(0).alias("hard"))

    def add(s: Column, w: Column) -> Column:
        return F.struct((s["n"] + 1).alias("n"), (s["total"] + w).alias("total"), (s["hard"] + (w >= 3).cast("int")).alias("hard"))

    return F.aggregate(F.transform(ascii_words(text), syllables), zero, add)


def grade_of(sums: Column, sentences: Column) -> Column:
    n = sums["n"]
    return F.when(n > 0, F.greatest(F.lit(0.0), 0.39 * n / sentences + 11.8 * sums["total"] / n - 15.59)).otherwise(F.lit(0.0))


def fog_of(sums: Column, sentences: Column) -> Column:
    n = sums["n"]
    return F.when(n > 0, 0.4 * (n / sentences + 100.0 * sums["hard"] / n)).otherwise(F.lit(0.0))


def flesch_kincaid(text: Column) -> Column:
    """0.39 words/sentences + 11.8 syllables/words - 15.59, at least 0; 0 without words."""
    return grade_of(syllable_sums(text), sentence_count(text))


def gunning_fog(text: Column) -> Column:
    """0.4 (words/sentences + 100 share of words with three syllables or more); 0 without words."""
    return fog_of(syllable_sums(text), sentence_count(text))


def readability(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, grade and fog: both measures from one count of each text's syllables, in batches of Arrow.

    Counting runs vectorised over all words of a batch at once, which interpreted lambdas over
    arrays of words can't do; the measures themselves are columns.
    """
    kind = dict(rows.dtypes)[key]
    counted = rows.select(key, text, sentence_count(F.col(text)).alias("_s")).mapInArrow(_counted, f"`{key}` {kind}, n long, total long, hard long, s int")
    sums = F.struct("n", "total", "hard")
    return counted.select(key, grade_of(sums, F.col("s")).alias("grade"), fog_of(sums, F.col("s")).alias("fog"))


_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def word_syllables(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Syllables of every word (run of ASCII letters) of many texts laid end to end, and where each text's words begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    letter, vowel = _LETTER[data], _VOWEL[data]
    opens = np.zeros(n, bool)
    opens[bounds[:-1][bounds[:-1] < n]] = True
    before = np.concatenate([[False], letter[:-1]]) & ~opens
    after = np.concatenate([letter[1:] & ~opens[1:], [False]])
    start, stop = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after)
    groups = vowel & ~(np.concatenate([[False], vowel[:-1]]) & before)
    sums = np.concatenate([[0], np.cumsum(groups)])
    many = sums[stop + 1] - sums[start]
    silent = ((data[stop] | 0x20) == ord("e")) & (many > 1)
    return np.maximum(1, many - silent), np.searchsorted(start, bounds)


def _sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their syllables, and those with three or more, of each text; null counts as empty."""
    raw = [(t or "").encode() for t in texts.to_pylist()]
    syl, first = word_syllables(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    total, hard = (np.diff(np.concatenate([[0], np.cumsum(x)])[first]).astype(np.int64) for x in (syl, syl >= 3))
    return np.diff(first), total, hard


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part[0], *map(pa.array, _sums(part[1])), part[2]], names=[part.schema.names[0], "n", "total", "hard", "s"])


def counted_syllables(text: Column) -> Column:
    """n, total and hard as ``syllable_sums`` gives them, counted in batches of Arrow over all words of 512 texts at once; zeros for null."""

    @F.arrow_udf("struct<n: long, total: long, hard: long>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [_sums(texts.slice(at, 512)) for at in range(0, max(len(texts), 1), 512)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["n", "total", "hard"])

    return run(text)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over characters; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.length(text)
    kinds = F.array_distinct(chars)
    each = F.transform(kinds, lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, -F.aggregate(each, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(F.lit(0.0))


def entropy_density(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 1, entropy(text) / F.log2(n)).otherwise(F.lit(0.0))


def consonant_ratio(text: Column) -> Column:
    """Letters that are not a, e, i, o, u among all letters; 0 without letters."""
    low = F.lower(text)
    letters = F.regexp_count(low, F.lit("\\p{L}"))
    return F.when(letters > 0, (letters - F.regexp_count(low, F.lit("[aeiou]"))) / letters).otherwise(F.lit(0.0))


def looks_random(text: Column) -> Column:
    """Five characters or more, dense, and nearly all consonants or with many digits."""
    digits = F.regexp_count(text, F.lit("[0-9]")) / F.length(text)
    density = entropy_density(text)
    return (F.length(text) >= 5) & (((density > 0.95) & (consonant_ratio(text) > 0.85)) | ((digits > 0.3) & (density > 0.85)))


def plain_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and spaces as their ASCII counterparts."""
    return F.translate(text, "‘’“”–—  ", "''\"\"--  ")


def evidence(text: Column, most: int = 200) -> Column:
    """The first characters of a text, as signals carry them."""
    return F.substring(text, 1, most)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1: twice the matched characters over both lengths, by longest common blocks, in any case; 0 where either is empty."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(xs, ys, strict=True)], dtype=float)

    return run(a, b)


def best_match(rows: DataFrame, key: str, text: str, candidates: list[str]) -> DataFrame:
    """key, match and score: the most similar of some candidates (a small list), of equal ones the first."""
    each = rows.select(key, text, F.posexplode(F.array(*map(F.lit, candidates))).alias("_i", "_candidate"))
    scored = each.withColumn("_score", similarity(F.col(text), F.col("_candidate")))
    best = F.max_by(F.struct("_candidate", "_score"), F.struct("_score", -F.col("_i")))
    return scored.groupBy(key).agg(best.alias("r")).select(key, F.col("r._candidate").alias("match"), F.col("r._score").alias("score"))
