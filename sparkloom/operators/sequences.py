"""Operators over ordered rows: lifecycles, expanding percentiles, smoothing, budgets, latest rows, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lifecycles(sightings: DataFrame, keys: list[str], day: str, repost_gap: int = 7, history: int = 20) -> DataFrame:
    """Per key: first and last day seen, days seen, reposts (gaps of more than ``repost_gap`` days), and the latest days.

    Days are deduplicated by the first aggregation, so a hot key costs at most one row a day.
    """
    days = sightings.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.count("*").alias("rows"))
    w = Window.partitionBy(*keys).orderBy(day)
    gaps = days.withColumn("gap", F.date_diff(F.col(day), F.lag(day).over(w)))
    seen = F.array_sort(F.collect_set(day))
    return gaps.groupBy(*keys).agg(
        F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count("*").alias("times_seen"), F.count_if(F.col("gap") > repost_gap).alias("times_reposted"),
        F.slice(seen, F.greatest(F.lit(1), F.size(seen) - history + 1), F.lit(history)).alias("latest_days"),
    )


def spread(cycles: DataFrame, key: str, platform: str) -> DataFrame:
    """Per key: on how many platforms, and the days first seen in order."""
    return cycles.groupBy(key).agg(F.count_distinct(platform).alias("platforms"), F.array_sort(F.collect_list("first_seen")).alias("first_days"))


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, block: Column | None = None) -> DataFrame:
    """Exponential moving average per key in order: the first value, then (1-a) old + a new; n rows.

    A step is an affine map of the average, and so are many steps in a row: the rows of each
    ``block`` (a value that grows with the order; by default its first column's day, for a
    timestamp) become one map by a partial aggregation, and a key's maps are few. So no task
    holds all the rows of a frequent key.
    """
    if block is None:
        block = F.to_date(order[0]) if dict(rows.dtypes)[order[0]].startswith("timestamp") else F.floor(F.col(order[0]) / 10_000)
    own = rows.where(F.col(value).isNotNull()).withColumn("_block", block)
    back = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*(F.desc(c) for c in order))) - 1
    at = F.struct(*order)
    maps = own.withColumn("_back", back).groupBy(key, "_block").agg(
        F.count("*").alias("m"), F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("_back")) * F.col(value)).alias("s"), F.min_by(F.col(value).cast("double"), at).alias("first")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_block", "m", "s", "first")))
    step = lambda e, b: b["s"] + F.pow(F.lit(1 - alpha), b["m"]) * F.coalesce(e, b["first"])
    return maps.groupBy(key).agg(F.aggregate(ordered, F.lit(None).cast("double"), step).alias("ema"), F.sum("m").alias("n"))


def within_budget(rows: DataFrame, part: str, newest: str, size: str, budget: int, width: int = 1000) -> DataFrame:
    """Rows kept when the oldest (by a whole number) are dropped until a part's total size fits; the newest always stays.

    Sums over ranges of ``width`` numbers tell which ranges lie wholly beyond the budget; only
    the rows of the others are ordered, so a part with very many rows is no task's load.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(newest) / width))
    sums = ranged.groupBy(part, "_range").agg(F.sum(size).alias("_size"))
    w = Window.partitionBy(part).orderBy(F.desc("_range"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = ranged.join(sums.where(F.col("_before") <= budget).select(part, "_range"), [part, "_range"], "left_semi")
    each = Window.partitionBy(part).orderBy(F.desc(newest))
    run = F.sum(size).over(each.rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("_run", run).withColumn("_rank", F.row_number().over(each)).where((F.col("_run") <= budget) | (F.col("_rank") == 1))
    return kept.select(*rows.columns)


def prior_state(sightings: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Each key's days with what was known of the key before: its first day and the number of its days."""
    days = sightings.where(F.col(day).isNotNull()).select(*keys, day).distinct()
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("first_before", F.min(day).over(w)).withColumn("seen_before", F.count(day).over(w))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by aggregation rather than a window: partial results combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (insert or ignore)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def gap_clusters(boxes: DataFrame, part: str, top: str, bottom: str, threshold: float) -> DataFrame:
    """Numbers runs of boxes: a new one where a top lies more than ``threshold`` below all bottoms before; boxes without a top come last."""
    w = Window.partitionBy(part).orderBy(F.asc_nulls_last(top), F.asc_nulls_last(bottom))
    before = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(top) - before > threshold, 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def backoff_seconds(retry: Column, base: int = 30) -> Column:
    """base * 2**(n-1) seconds for the first three retries, null (give up) after them."""
    return F.when(retry.between(1, 3), base * F.pow(F.lit(2.0), retry - 1))


def invalid_transitions(states: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose change of state is not in ``allowed``; staying in a state is always fine."""
    w = Window.partitionBy(key).orderBy(*order)
    moved = states.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    return moved.where(~F.concat_ws(">", "before", state).isin([f"{a}>{b}" for a, b in allowed]))
