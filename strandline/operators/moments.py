"""Moments as states that can be added up and taken back: rows of n, mean and the sums of the second to fourth powers of
differences from the mean (m2, m3, m4), for each key or for all.

States are small whatever they were made of, so parts of a table can be kept, merged, replaced and removed without reading
their rows again. Nulls do not count. A state of nothing has n = 0, null as its mean, and sums of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ["n", "mean", "m2", "m3", "m4"]


def state(df: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, state) of the values in df, in one pass that is combined before its shuffle."""
    v = F.col(value).cast("double")
    d = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("var"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("excess"))
    sums = [F.col("n") * F.col("var"), F.col("skew") * F.col("n") * F.pow("var", F.lit(1.5)), (F.col("excess") + 3) * F.col("n") * F.col("var") * F.col("var")]
    # of equal values there is neither skewness nor kurtosis, while the sums are 0
    return d.select(*keys, "n", "mean", *(F.when(F.col("var") > 0, x).otherwise(0.0).alias(f"m{i}") for i, x in enumerate(sums, 2)))


def merged(states: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """One state for each of keys, or for all rows: that of all values of its states together. States are read twice: for
    the common mean, and for what their sums are about it."""
    whole = states.groupBy(*keys).agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("mean")).alias("__total"))
    means = whole.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__total") / F.when(F.col("__n") > 0, F.col("__n"))).alias("__mean"))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & states[k].eqNullSafe(means[f"__{k}"])
        d = states.join(means, same)
    else:
        d = states.join(F.broadcast(means))  # one row
    n, m2, m3, m4 = (F.col(x) for x in ("n", "m2", "m3", "m4"))
    shift = F.coalesce(F.col("mean") - F.col("__mean"), F.lit(0.0))
    about = [m2 + n * shift**2, m3 + 3 * shift * m2 + n * shift**3, m4 + 4 * shift * m3 + 6 * shift**2 * m2 + n * shift**4]
    return d.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("n"), F.first("__mean", ignorenulls=True).alias("mean"), *(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"m{i}") for i, x in enumerate(about, 2)))


def removed(states: DataFrame, parts: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """states without the values of parts, which has at most one state for each key and only values that are in states.

    The job fails if a part has more values than its whole. Keys that parts does not have stay as they are, and keys that only
    parts has are left out.
    """
    b = parts.select(*[F.col(k).alias(f"__{k}") for k in keys], *(F.col(c).alias(f"p_{c}") for c in STATE))
    same = F.lit(True)
    for k in keys:
        same = same & states[k].eqNullSafe(b[f"__{k}"])
    d = states.join(b, same, "left") if keys else states.join(F.broadcast(b), how="left")
    c = F.col
    n = c("n") - c("p_n")
    mean = (c("n") * c("mean") - c("p_n") * c("p_mean")) / F.when(n > 0, n)
    d = d.where(F.col("p_n").isNull() | (F.col("p_n") <= F.col("n")) | F.raise_error(F.lit("more values are removed than there are")).isNull())
    d = d.withColumn("r", n).withColumn("r_mean", mean).withColumn("gap", c("p_mean") - c("r_mean"))
    r, p, gap, all_n = (c(x).cast("double") for x in ("r", "p_n", "gap", "n"))
    d = d.withColumn("r_m2", F.greatest(c("m2") - c("p_m2") - gap**2 * r * p / all_n, F.lit(0.0)))
    m2, p2 = c("r_m2"), c("p_m2")
    d = d.withColumn("r_m3", c("m3") - c("p_m3") - gap**3 * r * p * (r - p) / all_n**2 - 3 * gap * (r * p2 - p * m2) / all_n)
    m3, p3 = c("r_m3"), c("p_m3")
    d = d.withColumn("r_m4", F.greatest(c("m4") - c("p_m4") - gap**4 * r * p * (r**2 - r * p + p**2) / all_n**3 - 6 * gap**2 * (r**2 * p2 + p**2 * m2) / all_n**2 - 4 * gap * (r * p3 - p * m3) / all_n, F.lit(0.0)))

    def own(x: str) -> Column:
        rest = c("r") if x == "n" else c("r_mean") if x == "mean" else F.when(c("r") > 0, c(f"r_{x}")).otherwise(0.0)
        return F.when(c("p_n").isNull() | (c("p_n") == 0), c(x)).otherwise(rest).alias(x)

    return d.select(*keys, *map(own, STATE))


def described(states: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, n, total, mean, variance, stddev, skewness, kurtosis, excess, raw2, raw3, raw4) of states.

    variance and stddev are those of a sample; skewness is the third central moment over the sample variance to the power 1.5;
    kurtosis is the fourth central moment over the squared variance of all values, excess that less 3; raw moments are means of
    powers. Null where undefined.
    """
    c = F.col
    n = F.when(c("n") > 0, c("n").cast("double"))
    second, third, fourth = (c(x) / n for x in ("m2", "m3", "m4"))
    variance = c("m2") / F.when(n > 1, n - 1)
    full = fourth / F.when(c("m2") > 0, second**2)
    raw = [second + c("mean") ** 2, third + 3 * c("mean") * second + c("mean") ** 3, fourth + 4 * c("mean") * third + 6 * c("mean") ** 2 * second + c("mean") ** 4]
    shape = third / F.when(variance > 0, F.pow(variance, F.lit(1.5)))
    return states.select(*keys, "n", F.coalesce(c("n") * c("mean"), F.lit(0.0)).alias("total"), "mean", variance.alias("variance"), F.sqrt(variance).alias("stddev"), shape.alias("skewness"), full.alias("kurtosis"), (full - 3).alias("excess"), *(x.alias(f"raw{i}") for i, x in enumerate(raw, 2)))
