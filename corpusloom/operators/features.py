"""Features of papers: neighbourhoods, clustering, distance to relevant papers, semantics, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from ..plans.arcs import Arcs
from ..plans.materialize import materialize, observed
from ..plans.order import with_position
from .knn import greatest_cosine
from .triangles import triangles

#: Feature columns in their fixed order.
FEATURES = [
    "degree", "in_degree", "out_degree", "relevant_neighbors", "relevant_ratio", "clustering", "pagerank", "betweenness", "closeness", "eigenvector",
    "mean_neighbor_degree", "std_neighbor_degree", "max_neighbor_degree", "min_distance_to_relevant",
    "semantic_similarity_to_relevant", "semantic_isolation_score", "max_semantic_similarity", "publication_year", "title_length",
]

#: Distance of papers that reach no other relevant paper.
UNREACHABLE = 10.0


def degrees(edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, degree`` of nodes with edges; distinct edges, unweighted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
    out = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum(1 - F.col("e.o")).alias("in_degree"))
    return out.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct ``(id, nb)`` over both directions."""
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nb")))
    return edges.select(F.inline(both)).distinct()


def neighbourhood_features(papers: DataFrame, edges: DataFrame, relevance_col: str = "label_included") -> DataFrame:
    """Degrees, relevant neighbours and neighbour degrees of every paper; zeros outside the graph."""
    degree = degrees(edges)
    relevant = papers.where(F.col(relevance_col) == 1).select(F.col("id").alias("nb"), F.lit(1).alias("r")).distinct()
    near = neighbours(edges).join(degree.select(F.col("id").alias("nb"), F.col("degree").alias("d")), "nb").join(relevant, "nb", "left")
    near = near.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.coalesce("r", F.lit(0))).alias("relevant_neighbors"), F.avg("d").alias("mean_neighbor_degree"), F.stddev_pop("d").alias("std_neighbor_degree"), F.max("d").alias("max_neighbor_degree"))
    near = near.withColumn("relevant_ratio", F.col("relevant_neighbors") / F.greatest(F.lit(1), F.col("n"))).drop("n")
    wide = papers.select("id").join(degree, "id", "left").join(near, "id", "left")
    names = ["degree", "in_degree", "out_degree", "relevant_neighbors", "relevant_ratio", "mean_neighbor_degree", "std_neighbor_degree", "max_neighbor_degree"]
    return wide.select("id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))


def clustering(edges: DataFrame) -> DataFrame:
    """``id, clustering`` on the undirected simple graph: 2 T / (k (k - 1)), 0 below two neighbours.

    Every triangle is found once, in the task of its corners' colours (``triangles.py``); wedges are never rows.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    links, seen = observed(links, n=F.count("*"), low=F.min(F.expr("try_cast(b AS bigint)")), high=F.max(F.expr("try_cast(a AS bigint)")))
    size = materialize(links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k")))
    if links.schema["a"].dataType.typeName() in ("byte", "short", "integer", "long"):
        counts = triangles(links, seen["n"], narrow=bool(seen["n"]) and -(2**31) <= seen["low"] and seen["high"] < 2**31)
    else:  # other ids are numbered first
        names = materialize(with_position(size.select("id"), F.col("id"), name="at"))
        ends = links.join(names.select(F.col("id").alias("a"), F.col("at").alias("u")), "a").join(names.select(F.col("id").alias("b"), F.col("at").alias("v")), "b")
        counts = triangles(ends.select(F.col("u").alias("a"), F.col("v").alias("b")), seen["n"]).withColumnRenamed("id", "at").join(names, "at").drop("at")
    k = F.col("k").cast("double")
    return size.join(counts, "id", "left").select("id", F.when(k < 2, F.lit(0.0)).otherwise(2 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).alias("clustering"))


def distance_to_relevant(papers: DataFrame, nodes: DataFrame, edges: DataFrame, relevance_col: str = "label_included", max_rounds: int = 10_000) -> DataFrame:
    """``id, min_distance_to_relevant``: hops along outgoing citations to the nearest relevant paper other than itself.

    One breadth-first search from all relevant papers against the edges; each node keeps two of its nearest sources, so that a
    paper can leave itself out. Of the sources that a node hears of in a round, the least and the greatest are enough, a row of
    fixed size for each node: at least one of them is not the one it knows. A node that knows two hears nothing new, so rounds
    end at the graph's depth.
    """
    sources = papers.where(F.col(relevance_col) == 1).select("id").join(nodes.select("id"), "id", "left_semi").distinct()
    back = Arcs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    levels = [materialize(sources.select("id", F.col("id").alias("one"), F.nullif("id", "id").alias("two"), F.lit(0).alias("d")))]
    for d in range(1, max_rounds + 1):
        heard = back.along(levels[-1].select("id", "one", "two"), "id", "one", "two", once=True)
        heard = heard.groupBy(F.col("dst").alias("id")).agg(F.min(F.least("one", "two")).alias("least"), F.max(F.greatest("one", "two")).alias("most"))
        known = reduce(DataFrame.union, levels).groupBy("id").agg(F.min(F.least("one", "two")).alias("first"), F.max(F.greatest("one", "two")).alias("last"))
        new = heard.join(known, "id", "left").where("first IS NULL OR first = last AND NOT (least = first AND most = first)")
        one = F.when(F.col("least") == F.col("first"), F.col("most")).otherwise(F.col("least"))
        new = new.select("id", one.alias("one"), F.when(F.col("first").isNull(), F.nullif("most", "least")).alias("two"), F.lit(d).alias("d"))
        frontier, found = observed(new, n=F.count("*"))
        if not found["n"]:
            break
        levels.append(frontier)
    else:
        raise RuntimeError("breadth-first search did not end")
    near = reduce(DataFrame.union, levels).where("id <> one OR two IS NOT NULL").groupBy("id").agg(F.min("d").alias("d"))
    return papers.select("id").join(near, "id", "left").select("id", F.coalesce(F.col("d").cast("double"), F.lit(UNREACHABLE)).alias("min_distance_to_relevant"))


def semantic_features(papers: DataFrame, embeddings: DataFrame, relevance_col: str = "label_included") -> DataFrame:
    """Mean, isolation and greatest cosine to the relevant papers with embeddings, without the paper itself.

    The mean needs one sum vector. The greatest cosine is a matrix product with the relevant vectors, in blocks.
    Defaults (0, 1, 0) without an embedding or without another relevant paper; null, empty and non-finite vectors count as missing.
    """
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    units = materialize(embeddings.where(sound).select("id", unit(F.col("embedding")).alias("u")))
    flag = papers.where(F.col(relevance_col) == 1).select("id").distinct()
    relevant = materialize(units.join(flag, "id", "left_semi"))
    n = relevant.count()
    if not n:
        return papers.select("id", F.lit(0.0).alias("semantic_similarity_to_relevant"), F.lit(1.0).alias("semantic_isolation_score"), F.lit(0.0).alias("max_semantic_similarity"))
    total = relevant.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("total"))
    mine = units.join(relevant.select("id", F.lit(1).alias("r")), "id", "left").crossJoin(F.broadcast(total))  # one vector
    self_part = F.when(F.col("r") == 1, dot(F.col("u"), F.col("u"))).otherwise(F.lit(0.0))
    others = F.lit(n) - F.coalesce("r", F.lit(0))
    mean = mine.select("id", F.when(others > 0, (dot(F.col("u"), F.col("total")) - self_part) / others).alias("mean"))
    best = greatest_cosine(units, relevant)
    wide = papers.select("id").join(mean, "id", "left").join(best, "id", "left")
    return wide.select("id", F.coalesce("mean", F.lit(0.0)).alias("semantic_similarity_to_relevant"), F.coalesce(1 - F.col("mean"), F.lit(1.0)).alias("semantic_isolation_score"), F.coalesce("best", F.lit(0.0)).alias("max_semantic_similarity"))


def metadata_features(papers: DataFrame) -> DataFrame:
    """``publication_year`` (0 without a column) and ``title_length``: code points, 3 for null, 0 without a column."""
    year = F.coalesce(F.col("year").cast("double"), F.lit(0.0)) if "year" in papers.columns else F.lit(0.0)
    length = F.length(F.coalesce("title", F.lit("nan"))).cast("double") if "title" in papers.columns else F.lit(0.0)
    return papers.select("id", year.alias("publication_year"), length.alias("title_length"))


def join_features(papers: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """All parts by id; zeros outside the graph, ``UNREACHABLE`` for the distance."""
    wide = reduce(lambda a, b: a.join(b, "id", "left"), parts, papers.select("id"))
    return wide.select("id", *(F.coalesce(F.col(c).cast("double"), F.lit(UNREACHABLE if c == "min_distance_to_relevant" else 0.0)).alias(c) for c in FEATURES if c in wide.columns))
