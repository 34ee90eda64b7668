"""Corpus aggregations: rates, shares, funnels and histograms with explicit denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import percentiles


def percentile_per_key(rows: DataFrame, keys: list[str], value: str, p: float, least: int = 20) -> DataFrame:
    """keys, percentile and n: the linearly interpolated percentile of non-null values, for keys of ``least`` of them or more."""
    return percentiles(rows, keys, value, [p]).where(F.col("n") >= least).drop("p")


def mean_and_median(rows: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """keys, n (rows), mean and median of non-null values, for keys of ``least`` rows or more."""
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)
    middle = percentiles(rows, keys, value, [0.5]).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("percentile").alias("median"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return means.join(middle, same, "left").select(*keys, "n", "mean", "median")


def count_and_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n and mean per key combination, and the grand total (keys null) from the same scan."""
    return rows.groupingSets([keys, []], *keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))


def histogram(rows: DataFrame, by: str, label: str, labels: list[str]) -> DataFrame:
    """One row per ``by`` with a count for each of a fixed list of labels, 0 where none."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(label) == x).alias(x) for x in labels))


def shares(rows: DataFrame, label: str) -> DataFrame:
    """Counts by label with their share of all rows; null and empty labels read '(none)'."""
    name = F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("(none)"))
    counts = rows.groupBy(name.alias("label")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def rates(rows: DataFrame, key: str, hit: Column, grain: str) -> DataFrame:
    """n, hits and rate per non-null key, labelled with the grain; union several for more grains."""
    kept = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("entity")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return kept.select(F.lit(grain).alias("grain"), "entity", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"))


def ready_batches(rows: DataFrame, key: Column, seq: str, least: int = 3) -> DataFrame:
    """Keys with ``least`` members or more, the largest first, of equal ones the first seen first."""
    return rows.groupBy(key.alias("batch")).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq")).where(F.col("n") >= least)


def dedup_stats(rows: DataFrame, exact: str, signature: str, order: str) -> DataFrame:
    """Checks, exact duplicates, signature duplicates, unique rows and the rate of duplicates, when the first row of a signature stays.

    A duplicate is exact if it equals the row that stays. Sums per signature come first, so no
    task sees all the rows of a frequent one.
    """
    kept = rows.groupBy(signature).agg(F.min_by(exact, order).alias("_kept"), F.count("*").alias("_n"))
    same = rows.groupBy(signature, exact).agg(F.count("*").alias("_same"))
    each = kept.join(same.withColumnRenamed(signature, "_s"), F.col(signature).eqNullSafe(F.col("_s")) & F.col("_kept").eqNullSafe(F.col(exact)), "left")
    total = each.agg(F.sum("_n").alias("total_checks"), F.sum(F.col("_same") - 1).alias("exact_duplicates"), F.count("*").alias("unique_urls"))
    twice = F.col("total_checks") - F.col("unique_urls")
    return total.select("total_checks", "exact_duplicates", (twice - F.col("exact_duplicates")).alias("signature_duplicates"), "unique_urls", F.round(twice / F.col("total_checks"), 4).alias("duplicate_rate"))


def run_counters(rows: DataFrame, passes: Column, signature: str, order: str, off_shape: Column) -> DataFrame:
    """What a discovery run found, dropped and kept, by difference: raw_found, prefiltered, deduped, terminal, mined, enqueued.

    ``off_shape`` names where a kept row goes instead of the queue ("terminal" or "mined").
    """
    per = rows.groupBy(signature).agg(F.count("*").alias("_all"), F.count_if(passes).alias("_pass"), F.min_by(F.when(passes, off_shape), F.when(passes, F.col(order))).alias("_off"))
    some = F.col("_pass") > 0
    return per.agg(
        F.sum("_all").alias("raw_found"), (F.sum("_all") - F.sum("_pass")).alias("prefiltered"), (F.sum("_pass") - F.count_if(some)).alias("deduped"),
        F.count_if(some & (F.col("_off") == "terminal")).alias("terminal"), F.count_if(some & (F.col("_off") == "mined")).alias("mined"), F.count_if(some & F.col("_off").isNull()).alias("enqueued"),
    )
