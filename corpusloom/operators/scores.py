"""Normalisation, ensembles, ranks and percentiles of scores.

Long tables ``(method, id, score)`` carry all methods through one plan. Ranks never sort everything in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation, finite_or_zero
from ..plans.order import with_group_position
from ..plans.quantiles import exact_quantiles

TINY = 1e-8
#: Weights by method name; methods without one weigh one part of the number of methods.
CUSTOM_WEIGHTS = {"lof_embedding": 0.40, "lof_mixed": 0.30, "isolation_forest": 0.15, "one_class_svm": 0.10, "dbscan": 0.05}


def to_long(scores: DataFrame, methods: list[str], keep: list[str] = ()) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in methods))
    return scores.select("id", *keep, F.inline(pairs))


def standard_scale(features: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and infinite values to 0, then zero mean and unit population deviation; constant columns become 0."""
    clean = features.select("id", *(finite_or_zero(F.col(c)).alias(c) for c in columns))
    moments = clean.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    wide = clean.crossJoin(F.broadcast(moments))  # one row
    return wide.select("id", *(((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(F.lit(1.0))).alias(c) for c in columns))


def _with_stats(long: DataFrame, **stats) -> DataFrame:
    """``long`` with aggregates of its method; one row per method is broadcast."""
    return long.join(F.broadcast(long.groupBy("method").agg(*(v.alias(k) for k, v in stats.items()))), "method")


def min_max(long: DataFrame, least_range: float = TINY) -> DataFrame:
    wide = _with_stats(long, lo=F.min("score"), hi=F.max("score"))
    span = F.col("hi") - F.col("lo")
    return wide.withColumn("value", F.when(span > least_range, (F.col("score") - F.col("lo")) / span).otherwise(F.lit(0.0))).drop("lo", "hi")


def z_score(long: DataFrame) -> DataFrame:
    wide = _with_stats(long, m=F.avg("score"), s=F.stddev_pop("score"))
    return wide.withColumn("value", F.when(F.col("s") > TINY, (F.col("score") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0))).drop("m", "s")


def ordinal_ranks(long: DataFrame) -> DataFrame:
    """``r_ord``: 1 for the greatest score of the method, ties by id."""
    return with_group_position(long, "method", F.col("score").desc(), F.col("id"), name="r").withColumn("r_ord", F.col("r") + 1).drop("r")


def tie_ranks(long: DataFrame) -> DataFrame:
    """``r_ord, r_min, r_max, r_avg`` from the greatest score down, ``asc_avg`` from the least up, and ``n``."""
    ranked = ordinal_ranks(long)
    ties = ranked.groupBy("method", "score").agg(F.min("r_ord").alias("r_min"), F.max("r_ord").alias("r_max"))
    sizes = ranked.groupBy("method").agg(F.count("*").alias("n"))
    wide = ranked.join(ties, ["method", "score"]).join(F.broadcast(sizes), "method")
    wide = wide.withColumn("r_avg", (F.col("r_min") + F.col("r_max")) / 2)
    return wide.withColumn("asc_avg", F.col("n") + 1 - F.col("r_avg"))


def percentiles(ranked: DataFrame) -> DataFrame:
    """Five conventions: ``p_a`` of the ordinal rank, ``p_b`` and ``p_c`` of the least rank, ``p_d`` mean of strict and weak, ``p_e`` of the average."""
    n = F.col("n")
    return ranked.select(
        "*", ((n - F.col("r_ord") + 1) / n * 100).alias("p_a"), ((1 - F.col("r_min") / n) * 100).alias("p_b"), (F.col("r_min") / n * 100).alias("p_c"),
        ((n - F.col("r_max") + n - F.col("r_min") + 1) / 2 / n * 100).alias("p_d"), (F.col("asc_avg") / n * 100).alias("p_e"),
    )


def normalize(long: DataFrame, how: str) -> DataFrame:
    """``value`` by minmax, zscore, rank, percentile or quantile."""
    if how == "minmax":
        return min_max(long)
    if how == "zscore":
        return z_score(long)
    if how in ("rank", "percentile"):
        return tie_ranks(long).withColumn("value", F.col("asc_avg") / F.col("n")).select(*long.columns, "value")
    if how == "quantile":
        return quantile_transform(long)
    raise ValueError(f"unknown normalisation {how!r}")


def quantile_transform(long: DataFrame, quantiles: int | None = 1000) -> DataFrame:
    """To the uniform distribution: places on a grid of at most ``quantiles`` quantiles, or of all rows if it is None, averaged from both sides at ties."""
    sizes = long.groupBy("method").agg(F.count("*").alias("n"))
    counts = {r["method"]: r["n"] for r in sizes.collect()}  # one row per method
    parts, k = [], quantiles
    small = [m for m, n in counts.items() if quantiles is None or n <= quantiles]
    if small:  # every row is a point of the grid: ranks say it without rounding
        ranked = tie_ranks(long.where(F.col("method").isin(*small)))
        first, last = F.col("n") - F.col("r_max"), F.col("n") - F.col("r_min")
        value = F.when(first == 0, F.lit(0.0)).when(last == F.col("n") - 1, F.lit(1.0)).otherwise((first + last) / 2 / F.greatest(F.col("n") - 1, F.lit(1)))
        parts.append(ranked.withColumn("value", value).select(*long.columns, "value"))
    large = [m for m in counts if m not in small]
    if large:
        own = long.where(F.col("method").isin(*large))
        grid = exact_quantiles(own, F.col("score"), [i / (k - 1) for i in range(k)], F.col("method")).select(F.col("group").alias("method"), F.col("q").alias("g"))
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(k.bit_length()))))
        # bisection: how many of the grid lie below a score, or at most at it
        place = lambda less: F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(less(F.get("g", at + step - 1), F.col("score")), step).otherwise(0))
        wide = own.join(F.broadcast(grid), "method").withColumn("below", place(lambda a, b: a < b)).withColumn("upto", place(lambda a, b: a <= b))  # a row per method
        left, right = F.col("below") - 1, F.col("upto")
        tied = F.col("upto") > F.col("below")
        low, high = F.get("g", left), F.get("g", right)
        between = (left + (F.col("score") - low) / (high - low)) / F.lit(k - 1)
        middle = (F.col("below") + F.col("upto") - 1) / 2 / F.lit(k - 1)
        value = F.when(tied & (F.col("below") == 0), F.lit(0.0)).when(tied & (F.col("upto") == k), F.lit(1.0)).when(tied, middle).otherwise(between)
        parts.append(wide.withColumn("value", value).select(*long.columns, "value"))
    return reduce(DataFrame.union, parts) if parts else long.withColumn("value", F.lit(0.0))


def ensemble_weights(long: DataFrame, how: str = "variance") -> DataFrame:
    """``method, weight`` by variance of the min-max scores, uniform or custom; weights sum to 1."""
    if how == "variance":
        spread = min_max(long).groupBy("method").agg(F.var_pop("value").alias("v"))
    elif how == "uniform":
        spread = long.groupBy("method").agg(F.lit(1.0).alias("v"))
    elif how == "custom":
        spread = long.select("method").distinct()
        share = F.lit(1.0) / spread.count()
        known = F.create_map(*(F.lit(x) for kv in CUSTOM_WEIGHTS.items() for x in kv))
        spread = spread.select("method", F.coalesce(known[F.col("method")], share).alias("v"))
    else:
        raise ValueError(f"unknown weighting {how!r}")
    total = spread.agg(F.sum("v").alias("t"), F.count("*").alias("m"))
    return spread.crossJoin(total).select("method", F.when(F.col("t") > 0, F.col("v") / F.col("t")).otherwise(1 / F.col("m")).alias("weight"))


def weighted_ensemble(long: DataFrame, how: str = "variance") -> DataFrame:
    """``id, ensemble``: the weighted sum of min-max scores."""
    weighted = min_max(long).join(F.broadcast(ensemble_weights(long, how)), "method")
    return weighted.groupBy("id").agg(F.sum(F.col("value") * F.col("weight")).alias("ensemble"))


def reciprocal_rank_fusion(long: DataFrame, k: int = 60) -> DataFrame:
    """``id, ensemble``: the sum of 1 / (k + ordinal rank) over methods."""
    return ordinal_ranks(long).groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("r_ord"))).alias("ensemble"))


def fusion_diagnostics(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Per method the extremes and distinct values, with the correlation of the first two methods and whether they are equal."""
    first, second = (methods + methods)[:2]
    pair = scores.agg(correlation(F.col(first), F.col(second)).alias("correlation"), (F.count_if(F.col(first) != F.col(second)) == 0).alias("equal"))
    stats = to_long(scores, methods).groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_distinct("score").alias("distinct_scores"))
    return stats.crossJoin(F.broadcast(pair))
