"""Rankings, comparisons and metrics of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import performance_band
from ..plans.quantiles import exact_quantiles
from .scores import ordinal_ranks, percentiles, tie_ranks, to_long

#: Columns of a ranked result after rank, document_id and outlier_score.
CONTEXT = ["degree", "pagerank", "betweenness", "clustering", "semantic_similarity_to_relevant", "semantic_isolation_score"]


def top_outliers(scores: DataFrame, features: DataFrame, method: str, methods: list[str], top_k: int | None = 10) -> DataFrame:
    """Rows by falling score of ``method``, ties by id: rank, id, score, every method's score, context features."""
    if method not in scores.columns:
        raise ValueError(f"unknown method {method!r}")
    context = [c for c in CONTEXT if c in features.columns]
    long = to_long(scores, [method])
    if top_k is None:
        ranked = ordinal_ranks(long).select("id", F.col("r_ord").alias("rank"))
    else:
        best = long.orderBy(F.col("score").desc(), "id").limit(top_k)
        ranked = ordinal_ranks(best).select("id", F.col("r_ord").alias("rank"))
    wide = ranked.join(scores, "id").join(features.dropDuplicates(["id"]).select("id", *context), "id", "left")
    return wide.select(F.col("rank").cast("long").alias("rank"), F.col("id").alias("document_id"), F.col(method).alias("outlier_score"), *(F.col(m).alias(f"{m}_score") for m in methods), *context)


def method_comparison(scores: DataFrame, methods: list[str]) -> DataFrame:
    stats = to_long(scores, methods).groupBy("method").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    return stats.withColumn("range", F.col("max") - F.col("min"))


def detailed_breakdown(scores: DataFrame, methods: list[str], top_k: int = 10) -> DataFrame:
    """The first rows by ensemble with all scores and their rank."""
    best = scores.orderBy(F.col("ensemble").desc(), "id").limit(top_k)
    return ordinal_ranks(to_long(best, ["ensemble"])).select("id", F.col("r_ord").alias("rank_by_ensemble")).join(best, "id").select("rank_by_ensemble", "id", "ensemble", *methods)


def document_analysis(scores: DataFrame, methods: list[str], document: int | Column) -> DataFrame:
    """Of one document, a row per method: score, rank by the greater scores, percentile, band, number of documents. No sort."""
    long = to_long(scores, methods)
    own = long.where(F.col("id") == document).select("method", F.col("score").alias("mine"))
    found = long.join(F.broadcast(own), "method").groupBy("method", "mine").agg((F.count_if(F.col("score") > F.col("mine")) + 1).alias("rank"), F.count("*").alias("total"))
    percentile = (F.col("total") - F.col("rank") + 1) / F.col("total") * 100
    return found.select("method", F.col("mine").alias("score"), "rank", "total", percentile.alias("percentile"), performance_band(percentile).alias("band"))


def document_subscores(scores: DataFrame, methods: list[str], document: int) -> DataFrame:
    found = scores.where(F.col("id") == document).select("id", *methods)
    if found.isEmpty():
        raise ValueError(f"document {document} has no scores")
    return found


def convert_record_ids(records: DataFrame, papers: DataFrame) -> DataFrame:
    """``position, record_id, openalex_id`` of a list of records; unknown records are dropped; of repeated records the last counts."""
    if not {"record_id", "openalex_id"} <= set(papers.columns):
        return records.sparkSession.createDataFrame([], "position long, record_id long, openalex_id string")
    last = papers.groupBy("record_id").agg(F.max("openalex_id").alias("openalex_id"))
    return records.join(last, "record_id").select("position", "record_id", "openalex_id")


def known_outlier_ranks(scores: DataFrame, outliers: DataFrame, method: str = "ensemble") -> DataFrame:
    """Ordinal rank and percentile of each known outlier ``outliers(id)``."""
    ranked = percentiles(tie_ranks(to_long(scores, [method])))
    return ranked.join(F.broadcast(outliers.select("id").distinct()), "id").select("id", "score", F.col("r_ord").alias("rank"), F.col("n").alias("total"), F.col("p_a").alias("percentile"))


def auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``auc``: by rank sums, ties at their average; 0 with one class."""
    ranked = tie_ranks(scores.select("id", F.lit("m").alias("method"), F.col(score).cast("double").alias("score"), F.col(label).alias("y")))
    sums = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("asc_avg"))).alias("s"), F.count_if(F.col("y") == 1).cast("double").alias("p"), F.count_if(F.col("y") != 1).cast("double").alias("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).otherwise(F.lit(0.0)).alias("auc"))


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def threshold_metrics(scores: DataFrame, score: str, label: str, threshold: float | Column) -> DataFrame:
    """One row: counts, precision, recall, F1 (0 where undefined), accuracy, AUC, mean scores by class."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, true = F.col(score) >= t, F.col(label) == 1
    sums = scores.agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"),
        F.coalesce(F.avg(F.when(true, F.col(score))), F.lit(0.0)).alias("mean_relevant"), F.coalesce(F.avg(F.when(~true, F.col(score))), F.lit(0.0)).alias("mean_irrelevant"),
    )
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    wide = sums.select("*", *(v.alias(k) for k, v in rates.items()), ((F.col("tp") + F.col("tn")) / total).alias("accuracy"))
    return wide.crossJoin(auc(scores, score, label))  # one row each


def threshold_sweep(scores: DataFrame, score: str, label: str, steps: int = 81, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """``threshold, f1`` of every step of a grid: one pass that counts rows by grid cell, then sums over the few cells."""
    width = (high - low) / (steps - 1)
    # the number of grid values at or below the score
    below = F.aggregate(F.array(*(F.lit(round(low + i * width, 10)) for i in range(steps))), F.lit(0), lambda n, t: n + F.when(F.col(score) >= t, 1).otherwise(0))
    cells = scores.groupBy(below.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    grid = scores.sparkSession.range(steps).select(F.col("id").cast("int").alias("i"), F.round(F.lit(low) + F.col("id") * width, 10).alias("threshold"))
    pairs = F.broadcast(cells.crossJoin(F.broadcast(grid)))  # 82 cells by 81 steps
    above = F.col("cell") > F.col("i")
    sums = pairs.groupBy("threshold").agg(F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(~above, F.col("p")).otherwise(0)).alias("fn"))
    return sums.select("threshold", _rates(F.col("tp"), F.col("fp"), F.col("fn"))["f1"].alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold of greatest F1; 0.5 and 0 if all are 0."""
    best = sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    found = F.coalesce(F.col("b.f1"), F.lit(0.0)) > 0
    return best.select(F.when(found, F.col("b.threshold")).otherwise(F.lit(0.5)).alias("threshold"), F.when(found, F.col("b.f1")).otherwise(F.lit(0.0)).alias("f1"))


def outlier_metrics(scores: DataFrame, score: str, label: str, contamination: float = 0.1) -> DataFrame:
    """Metrics at the score that leaves a share ``contamination`` above it."""
    found = exact_quantiles(scores, F.col(score), [1 - contamination]).first()
    cut = found["q"][0] if found else None
    wide = threshold_metrics(scores, score, label, float(cut or 0.0))
    return wide.withColumn("threshold", F.lit(cut)).withColumn("predicted", F.col("tp") + F.col("fp"))


def score_distribution(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Per class: count, moments, quantiles; difference of means and share of other scores above the relevant mean."""
    s = F.col(score)
    rows = scores.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))
    quantiles = exact_quantiles(scores, s, [0.5, 0.75, 0.9], F.col(label)).select("group", "q")
    rows = rows.join(F.broadcast(quantiles), F.col("label").eqNullSafe(F.col("group")), "left")  # a row per class
    means = scores.agg(F.avg(F.when(F.col(label) == 1, s)).alias("m1"), F.avg(F.when(F.col(label) != 1, s)).alias("m0"))
    above = scores.crossJoin(F.broadcast(means)).agg((F.count_if((F.col(label) != 1) & (s > F.col("m1"))) / F.nullif(F.count_if(F.col(label) != 1), F.lit(0))).alias("overlap_ratio"), F.first(F.col("m1") - F.col("m0")).alias("mean_difference"))
    return rows.crossJoin(F.broadcast(above)).select("label", "n", "mean", "std", "min", "max", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p75"), F.get("q", F.lit(2)).alias("p90"), "mean_difference", "overlap_ratio")


def dataset_statistics(scores: DataFrame, features: DataFrame, score: str = "ensemble", label: str = "label_included", group: str = "dataset") -> DataFrame:
    """Per dataset: size, relevance, mean features, share of papers with citations (its ``network_density``), scores."""
    wide = scores.join(features.drop(label, group), "id", "left")
    wanted = [c for c in ("degree", "pagerank", "clustering") if c in features.columns]
    return wide.groupBy(group).agg(
        F.count("*").alias("documents"), F.sum(label).cast("long").alias("relevant"), F.avg(label).alias("relevance_ratio"), *(F.avg(c).alias(f"mean_{c}") for c in wanted),
        F.avg((F.col("degree") > 0).cast("double")).alias("network_density"), F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
    )


def rank_improvement(scores: DataFrame, methods: list[str], baselines: DataFrame, nonzero: tuple[str, ...] = ("lof_embeddings",)) -> DataFrame:
    """Of each ``baselines(id, original_rank)`` and method: new rank, change, relative change, percentiles and their difference.

    Methods in ``nonzero`` rank among positive scores alone, and a rank is one more than the greater scores. The original percentile is of all
    rows, the new one of those that the method ranks.
    """
    ranked = tie_ranks(to_long(scores, methods).where(~F.col("method").isin(*nonzero) | (F.col("score") > 0)))
    found = ranked.join(baselines.select("id", "original_rank"), "id").crossJoin(F.broadcast(scores.agg(F.count("*").alias("all"))))  # one row
    change = F.col("original_rank") - F.col("r_min")
    old, new = (1 - F.col("original_rank") / F.col("all")) * 100, (1 - F.col("r_min") / F.col("n")) * 100
    return found.select(
        "method", F.col("id").alias("outlier_id"), "score", "original_rank", F.col("r_min").alias("new_rank"), F.col("n").alias("total"), change.alias("rank_improvement"),
        (change / F.col("original_rank") * 100).alias("relative_improvement_percent"), old.alias("original_percentile"), new.alias("new_percentile"), (new - old).alias("percentile_improvement"),
    )
