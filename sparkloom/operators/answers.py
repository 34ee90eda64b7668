"""Answers of mixed type, kept as JSON: tallies of choices, medians, rates with intervals, and validation.

An answer is one JSON value: a choice, a list of choices, a number, true or false, a free text
or null. It is read as a VARIANT, so a question may have answers of every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .selection import percentiles


def kind(value: Column) -> Column:
    """list, text, number, truth, object or none of a VARIANT; null where the JSON didn't parse (a null VARIANT)."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(name.startswith("ARRAY"), "list")
        .when(name == "STRING", "text")
        .when(name == "BOOLEAN", "truth")
        .when(name == "VOID", "none")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def typed(rows: DataFrame, answer: str) -> DataFrame:
    """``rows`` with _value (VARIANT) and _kind; an answer that is missing is none, one that is no JSON is invalid."""
    out = rows.withColumn("_value", F.try_parse_json(F.col(answer)))
    return out.withColumn("_kind", F.when(F.col(answer).isNull(), "none").otherwise(F.coalesce(kind(F.col("_value")), F.lit("invalid"))))


def _choices(own: DataFrame) -> Column:
    """The choices of an answer, each once: a text is one, of a list its texts, numbers and truths as text, not its nulls."""
    listed = F.expr("try_variant_get(_value, '$', 'array<string>')")
    return F.when(F.col("_kind") == "list", F.array_distinct(F.filter(listed, lambda x: x.isNotNull()))).when(F.col("_kind") == "text", F.array(F.expr("try_variant_get(_value, '$', 'string')")))


def tallies(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """question, choice, n, share, low, high: how many of a question's valid answers made a choice, with the share's Wilson interval.

    An answer that names a choice twice counts once; none and invalid answers are not counted in the share.
    """
    own = typed(rows.select(question, answer), answer)
    valid = own.where(~F.col("_kind").isin("none", "invalid")).groupBy(F.col(question).alias("_q")).agg(F.count("*").alias("_all"))
    each = own.select(question, F.explode(_choices(own)).alias("choice")).groupBy(question, "choice").agg(F.count("*").alias("n"))
    both = each.join(valid, F.col(question).eqNullSafe(F.col("_q")))
    low, high = wilson(F.col("n"), F.col("_all"))
    return both.select(question, "choice", "n", (F.col("n") / F.col("_all")).alias("share"), low.alias("low"), high.alias("high"))


def insights(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """A row a question: answers by type, the median of its numbers, and the rate of true among its truths with the Wilson interval."""
    own = typed(rows.select(question, answer), answer)
    number, truth = F.expr("CASE WHEN _kind = 'number' THEN try_variant_get(_value, '$', 'double') END"), F.expr("CASE WHEN _kind = 'truth' THEN try_variant_get(_value, '$', 'boolean') END")
    told = own.select(question, "_kind", number.alias("_number"), truth.alias("_truth"))
    counts = {c: F.count_if(F.col("_kind") == k) for c, k in (("n_lists", "list"), ("n_texts", "text"), ("n_numbers", "number"), ("n_truths", "truth"), ("n_none", "none"), ("n_invalid", "invalid"))}
    sums = told.groupBy(question).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in counts.items()), F.count_if("_truth").alias("n_true"))
    middle = percentiles(told, [question], "_number", [0.5]).select(F.col(question).alias("_q"), F.col("percentile").alias("median"))
    low, high = wilson(F.col("n_true"), F.col("n_truths"))
    out = sums.join(middle, F.col(question).eqNullSafe(F.col("_q")), "left")
    return out.select(question, "n", *counts, "median", F.try_divide("n_true", "n_truths").alias("rate"), low.alias("low"), high.alias("high"))


def validated(rows: DataFrame, question: str, answer: str, rules: DataFrame) -> DataFrame:
    """``rows`` with problems, an array of what an answer breaks of its question's rule, in a fixed order.

    ``rules`` has one row a question: kind (as of ``kind``), required, choices (null: any), low
    and high (of numbers; null: unbounded). Problems are: unknown question, invalid, missing,
    wrong kind, unknown choice, too low, too high.
    """
    rule = rules.select(F.col(question).alias("_q"), *(F.col(c).alias(f"_r_{c}") for c in ("kind", "required", "choices", "low", "high")))
    own = typed(rows, answer).join(rule, F.col(question) == F.col("_q"), "left")
    x = F.expr("CASE WHEN _kind = 'number' THEN try_variant_get(_value, '$', 'double') END")
    known = F.col("_q").isNotNull()
    same = F.col("_kind") == F.col("_r_kind")
    checks = [
        F.when(~known, "unknown question"), F.when(F.col("_kind") == "invalid", "invalid"), F.when(known & F.col("_r_required") & (F.col("_kind") == "none"), "missing"),
        F.when(known & ~same & ~F.col("_kind").isin("none", "invalid"), "wrong kind"), F.when(same & F.exists(_choices(own), lambda c: ~F.array_contains("_r_choices", c)), "unknown choice"),
        F.when(same & (x < F.col("_r_low")), "too low"), F.when(same & (x > F.col("_r_high")), "too high"),
    ]
    return own.select(*rows.columns, F.array_compact(F.array(*checks)).alias("problems"))
