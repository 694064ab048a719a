"""Citation graphs: nodes, weighted edges, statistics, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components


def build_nodes(corpus: DataFrame, eligible_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """All corpus documents as nodes, with whether the simulation has them, and their type."""
    flag = eligible_ids.select(F.col(id_col)).distinct().withColumn("simulation_eligible", F.lit(True))
    nodes = corpus.join(flag, id_col, "left").withColumn("simulation_eligible", F.coalesce("simulation_eligible", F.lit(False)))
    return nodes.withColumn("node_type", F.when(F.col("simulation_eligible"), "simulation").otherwise("background"))


def explode_references(corpus: DataFrame, id_col: str = "id", refs_col: str = "referenced_works") -> DataFrame:
    """One ``(src, dst)`` row per reference; null lists have none."""
    return corpus.select(F.col(id_col).alias("src"), F.explode(refs_col).alias("dst"))


def build_edges(references: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """``src, dst, weight, edge_type``: no self-citations, both ends are nodes, weight is 1 + the number of citations."""
    ids = nodes.select(F.col(id_col).alias("n"))
    counted = references.where("src <> dst").groupBy("src", "dst").agg((F.count("*") + F.lit(1.0)).alias("weight"))
    kept = counted.join(ids.select(F.col("n").alias("dst")), "dst", "left_semi").join(ids.select(F.col("n").alias("src")), "src", "left_semi")
    return kept.select("src", "dst", "weight", F.lit("citation").alias("edge_type"))


def simulation_graph(papers: DataFrame, references: DataFrame | None, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The fallback graph of the papers alone; without references it has no edges."""
    nodes = build_nodes(papers, papers, id_col)
    if references is None:
        references = papers.select(F.col(id_col).alias("src"), F.col(id_col).alias("dst")).limit(0)
    return nodes, build_edges(references, nodes, id_col)


def missing_ids(papers: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of papers that are not eligible nodes."""
    return papers.select(id_col).join(nodes.where("simulation_eligible").select(id_col), id_col, "left_anti")


def network_stats(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: counts, density, weak connectivity; an empty graph has density 0 and is not connected."""
    counts = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.count_if("simulation_eligible"), F.lit(0)).alias("eligible"))
    parts = connected_components(edges)
    grouped = parts.agg(F.count("*").alias("linked"), F.count_if(F.col("id") == F.col("component")).alias("roots"))
    size = edges.agg(F.count("*").alias("edges"))
    row = counts.crossJoin(size).crossJoin(grouped)  # three rows of one
    possible = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    components = F.col("nodes") - F.col("linked") + F.col("roots")
    return row.select(
        "nodes", "edges", "eligible", (F.col("nodes") - F.col("eligible")).alias("background"),
        F.when(possible > 0, F.col("edges") / possible).otherwise(F.lit(0.0)).alias("density"), (components == 1).alias("connected"), components.alias("components"),
    )


def citation_patterns(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """How many distinct citations go from which kind of node to which; background to background is not reported."""
    kind = nodes.select(F.col(id_col), F.when(F.col("simulation_eligible"), "sim").otherwise("bg").alias("k"))
    ends = edges.join(kind.select(F.col(id_col).alias("src"), F.col("k").alias("a")), "src").join(kind.select(F.col(id_col).alias("dst"), F.col("k").alias("b")), "dst")
    counts = ends.groupBy(F.concat_ws("_to_", "a", "b").alias("pattern")).agg(F.count("*").alias("n"))
    shape = edges.sparkSession.createDataFrame([("sim_to_sim",), ("sim_to_bg",), ("bg_to_sim",)], "pattern string")
    return shape.join(counts, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))
