"""Statistics as column expressions: intervals, exact tests, distances."""

from __future__ import annotations

from math import lgamma, log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided normal quantiles by confidence level.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}
EARTH_MILES = 3958.8
#: Fixed value: cells of an exact test that a task makes from one row.
CELLS = 1 << 14


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clamped to 0..1; null for n = 0."""
    z = Z[confidence]
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    none = F.lit(None).cast("double")
    return tuple(F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(none) for x in (centre - half, centre + half))


def ln_factorial(n: Column) -> Column:
    """ln(n!): from a table under 16, else by Stirling's series, whose next term is under 2e-14 there."""
    x = F.greatest(n, F.lit(16)).cast("double")
    y = 1 / (x * x)
    series = (x + 0.5) * F.ln(x) - x + log(2 * pi) / 2 + (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / x
    small = F.array(*(F.lit(lgamma(k + 1)) for k in range(16)))
    return F.when(n < 16, F.get(small, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def fisher_exact(tables: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d", key: str = "key") -> DataFrame:
    """``key``, p_value: the two-tailed exact test of 2x2 tables, one a row.

    Sums the probabilities of all tables with the same margins that are at most as likely as
    the one observed (with a relative slack of 1e-9). The sum runs over the possible first
    cells, which are dealt to tasks in blocks; each costs the same, whatever the margins.
    """
    a, b, c, d = (F.col(x).cast("long") for x in (a, b, c, d))
    rows = tables.select(F.col(key), (a + b).alias("r1"), (c + d).alias("r2"), (a + c).alias("c1"), (a + b + c + d).alias("n"), a.alias("seen"))
    rows = rows.withColumn("const", ln_factorial(F.col("r1")) + ln_factorial(F.col("r2")) + ln_factorial(F.col("c1")) + ln_factorial(F.col("n") - F.col("c1")) - ln_factorial(F.col("n")))

    def ln_p(x: Column) -> Column:
        # Cells that mirror each other (r1 = r2) get the same sum, so the slack needn't bear its rounding.
        return F.col("const") - ((ln_factorial(x) + ln_factorial(F.col("c1") - x)) + (ln_factorial(F.col("r1") - x) + ln_factorial(F.col("r2") - F.col("c1") + x)))

    rows = rows.withColumn("p_seen", F.exp(ln_p(F.col("seen"))))
    rows = rows.withColumn("last", F.least("r1", "c1")).withColumn("from", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c1") - F.col("r2")), F.col("last"), F.lit(CELLS))))
    dealt = rows.repartition(int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = dealt.withColumn("x", F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + CELLS - 1))))
    cells = cells.withColumn("p", F.exp(ln_p(F.col("x"))))
    return cells.groupBy(key).agg(F.least(F.lit(1.0), F.sum(F.when(F.col("p") <= F.col("p_seen") * (1 + 1e-9), F.col("p")).otherwise(0.0))).alias("p_value"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, from a series for the error function whose terms are all positive; 0 or 1 beyond 6."""
    x = F.least(F.abs(z), F.lit(6.0)) / sqrt(2)
    start = F.struct(x.alias("term"), x.alias("total"))

    def grow(s: Column, k: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    erf = 2 / sqrt(pi) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, grow)["total"]
    return 0.5 * (1 + F.signum(z) * F.least(F.lit(1.0), erf))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
