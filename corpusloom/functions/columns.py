"""Column expressions for identifiers, texts and dirty numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import exact_quantiles

#: Label columns by priority.
LABELS = ["included", "label_included", "label", "relevant"]
PREFIX = "https://openalex.org/"


def resolve_label(df: DataFrame) -> str:
    """The first label column that the table has."""
    for name in LABELS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {LABELS} among {df.columns}")


def resolve_like(df: DataFrame, part: str) -> str | None:
    """The first column whose name contains ``part`` in any case."""
    return next((c for c in df.columns if part in c.lower()), None)


def canonical_openalex(c: Column) -> Column:
    """Links stay; identifiers with or without their letter become links; empty stays empty."""
    return F.when(c.startswith("https://") | (c == ""), c).when(c.startswith("W"), F.concat(F.lit(PREFIX), c)).otherwise(F.concat(F.lit(PREFIX + "W"), c))


def title_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def embedding_text(title: Column, abstract: Column, separator: str = "[SEP]") -> Column:
    """Trimmed title, separator, trimmed abstract; null when both are blank."""
    t, a = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(abstract, F.lit("")))
    return F.when((t != "") | (a != ""), F.concat(t, F.lit(separator), a))


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def clamp_infinite(c: Column, bound: float = 1e6) -> Column:
    """Infinities become plus or minus ``bound``, missing values 0."""
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).when(c == float("inf"), F.lit(bound)).when(c == float("-inf"), F.lit(-bound)).otherwise(c)


def display_name(c: Column) -> Column:
    """A feature's label: spaces, a short form of neighbor, title case, at most 20 characters."""
    text = F.initcap(F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("neighbor"), F.lit("neighb.")))
    return F.when(F.length(text) > 20, F.concat(F.substring(text, 1, 17), F.lit("..."))).otherwise(text)


#: Least percentiles and names of the bands, in analyses of a document and in summaries of known outliers.
ANALYSIS_BANDS = [(95, "Excellent outlier detection"), (90, "Very good outlier detection"), (80, "Good outlier detection"), (None, "Moderate outlier score")]
SUMMARY_BANDS = [(95, "Excellent"), (90, "Very Good"), (80, "Good"), (None, "Poor")]


def performance_band(percentile: Column, bands: list[tuple[int | None, str]] = ANALYSIS_BANDS) -> Column:
    named = F.coalesce(*(F.when(percentile >= least, name) for least, name in bands if least is not None))
    return F.coalesce(named, F.lit(bands[-1][1]))


def clean_with_statistics(df: DataFrame, column: str) -> DataFrame:
    """Missing values become the finite median, infinities the finite extremes."""
    c = F.col(column)
    good = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    ends = df.agg(F.max(good).alias("__hi"), F.min(good).alias("__lo"))
    stats = ends.join(exact_quantiles(df, good, [0.5]).select(F.get("q", F.lit(0)).alias("__m")), how="left")  # one row, and one or none
    cleaned = F.when(c.isNull() | F.isnan(c), F.col("__m")).when(c == float("inf"), F.col("__hi")).when(c == float("-inf"), F.col("__lo")).otherwise(c)
    return df.crossJoin(F.broadcast(stats)).withColumn(column, cleaned).drop("__m", "__hi", "__lo")  # one row


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, null where either side is constant."""
    a, b = a.cast("double"), b.cast("double")
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
