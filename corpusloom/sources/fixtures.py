"""The engine's inputs, derived from the star-schema and document tables.

Papers are documents, relevant where labelled toxic; their title is the first line, their abstract the rest. Lines of an order, in
sequence, cite each other: the document of a line cites that of the next. Embeddings belong to the document of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """``id, openalex_id, title, abstract, label_included, dataset``."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://openalex.org/W"), F.col("doc_id").cast("string")).alias("openalex_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)").alias("abstract"),
        F.coalesce("label", F.lit(0)).cast("int").alias("label_included"), F.col("lang").alias("dataset"),
    )


def paper_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``id, label_included, eligible, dataset``; labelled documents are the simulation's, others background. No texts are read."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("dataset"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    joined = docs.join(labels, "id", "left")
    return joined.select("id", F.coalesce("label", F.lit(0)).cast("int").alias("label_included"), F.col("label").isNotNull().alias("eligible"), "dataset")


def references(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst``: one row for every citation, repeats and self-citations included."""
    n = table(spark, folder, "documents").count()
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.withColumn("node", F.col("l_partkey") % F.lit(n))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(F.col("node").alias("src"), F.lead("node").over(order).alias("dst")).where("dst is not null")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """``id, embedding`` of vectors whose number is a document's."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id", "left_semi")


def _wave(column: Column, factor: int, modulus: int) -> Column:
    return (column * factor % modulus).cast("double")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic scores of four detectors: ``id, label_included, dataset`` and a column each; 0 without an embedding."""
    ids = paper_ids(spark, folder).drop("eligible")
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("known")).distinct()
    i = F.col("id")
    return ids.join(known, "id", "left").select(
        "id", "label_included", "dataset",
        F.when(F.col("known"), 1 + _wave(i, 37, 101) / 100).otherwise(F.lit(0.0)).alias("lof_embeddings"),
        (_wave(i, 73, 97) / 50 + F.col("label_included") * 0.25).alias("lof_network"), (_wave(i, 91, 89) / 60).alias("lof_mixed"),
        (_wave(i, 57, 83) / 83 - 0.5).alias("isolation_forest"),
    )


def screening_log(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, label, time``: documents in a scattered, dense order of review."""
    ids = paper_ids(spark, folder)
    n = ids.count()
    return ids.select(F.col("id").alias("record_id"), F.col("label_included").alias("label"), (F.col("id") * 7919 % F.lit(n)).alias("time"))
