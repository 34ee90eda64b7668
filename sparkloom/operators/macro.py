"""Signals over aggregates: sector ratios, entities that never answer, and paired trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fisher_exact, wilson
from .selection import percentiles

#: Sectors that a median needs, and the range about it that is normal; applications that a rate needs, and the rate below which nothing comes back.
LEAST_SECTORS, NORMAL = 3, (0.5, 2.0)
LEAST_SENT, LEAST_RATE = 10, 0.05


def sector_ratios(sectors: DataFrame, sector: str, postings: str, openings: str) -> DataFrame:
    """sector, severity, confidence, against (LM-01): sectors whose postings for each known opening are far from the sectors' median.

    Sectors without openings count for nothing; with fewer than three others, or a median of 0, there is no signal.
    """
    own = sectors.where(F.col(openings) > 0).select(sector, (F.col(postings) / F.col(openings)).alias("_ratio"))
    middle = percentiles(own.withColumn("_one", F.lit(1)), ["_one"], "_ratio", [0.5]).where((F.col("n") >= LEAST_SECTORS) & (F.col("percentile") > 0)).select("percentile")
    both = own.join(middle).withColumn("against", F.col("_ratio") / F.col("percentile"))  # one row beside each
    return both.where(~F.col("against").between(*NORMAL)).select(sector, F.lit("flag").alias("severity"), F.lit(0.6).alias("confidence"), "against")


def black_holes(records: DataFrame, entity: str, sent: Column, received: Column) -> DataFrame:
    """entity, n, severity, confidence (LM-02): entities that answered under one in twenty of ten applications or more."""
    sums = records.groupBy(entity).agg(F.count_if(sent).alias("n"), F.count_if(sent & received).alias("_got"))
    found = sums.where((F.col("n") >= LEAST_SENT) & (F.col("_got") / F.col("n") < LEAST_RATE))
    return found.select(entity, "n", F.lit("flag").alias("severity"), F.least(F.lit(0.85), 0.5 + F.col("n") / 200).alias("confidence"))


def paired_trials(submissions: DataFrame, pair: str, trial: str, arm: str, submitted: Column, callback: Column) -> DataFrame:
    """A row a pair: n_pairs, callbacks and rates of both arms with Wilson bounds, their difference, the exact p-value, and whether it is under 0.05.

    ``arm`` is "a" or "b". The two arms meet by pair and trial first; trials in which not both
    were submitted count for neither, and a pair without any is left out. A trial that comes
    several times counts once: submitted or called back if any of its rows says so.
    """
    own = submissions.where(F.col(arm).isin("a", "b") & F.col(trial).isNotNull()).select(pair, trial, F.col(arm).alias("_arm"), submitted.alias("_sent"), callback.alias("_back"))
    whole = own.groupBy(pair, trial).agg(*(F.coalesce(F.bool_or(F.when(F.col("_arm") == x, F.col(c))), F.lit(False)).alias(f"{x}{c}") for x in "ab" for c in ("_sent", "_back")))
    sums = whole.where("a_sent and b_sent").groupBy(pair).agg(F.count("*").alias("n_pairs"), F.count_if("a_back").alias("a"), F.count_if("b_back").alias("c"))
    p = fisher_exact(sums.select(F.col(pair).alias("_pair"), "a", (F.col("n_pairs") - F.col("a")).alias("b"), "c", (F.col("n_pairs") - F.col("c")).alias("d")), key="_pair")
    both = sums.join(p, F.col(pair) == F.col("_pair"))
    (la, ha), (lb, hb) = wilson(F.col("a"), F.col("n_pairs")), wilson(F.col("c"), F.col("n_pairs"))
    ra, rb = F.col("a") / F.col("n_pairs"), F.col("c") / F.col("n_pairs")
    return both.select(
        pair, "n_pairs", F.col("a").alias("a_callbacks"), F.col("c").alias("b_callbacks"), ra.alias("a_rate"), rb.alias("b_rate"), la.alias("a_low"), ha.alias("a_high"), lb.alias("b_low"), hb.alias("b_high"),
        (ra - rb).alias("difference"), "p_value", (F.col("p_value") < 0.05).alias("significant"),
    )
