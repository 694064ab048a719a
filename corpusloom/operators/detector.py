"""The whole analysis behind one class: graph, features, four detectors, ensemble, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from . import centrality, evaluation, features, graph, outliers, scores
from .iforest import isolation_forest

METHODS = ["lof_embeddings", "lof_network", "lof_mixed", "isolation_forest"]


class CitationOutlierDetector:
    """Outlier scores for papers of a citation graph.

    ``fit`` takes ``papers(id, title, label_included)``, optionally references ``(src, dst)``, the corpus whose documents are
    nodes beside the papers, and ``embeddings(id, embedding)``. Results are DataFrames; asking before ``fit`` raises ValueError.
    """

    def __init__(self, random_state: int = 42, use_rrf: bool = False, weighting: str = "variance", pivots: DataFrame | None = None):
        self.random_state, self.use_rrf, self.weighting, self.pivots = random_state, use_rrf, weighting, pivots
        self._scores: DataFrame | None = None

    def fit(self, papers: DataFrame, references: DataFrame | None = None, corpus: DataFrame | None = None, embeddings: DataFrame | None = None, relevance_col: str = "label_included") -> DataFrame:
        spark = papers.sparkSession
        papers = materialize(papers)
        if corpus is None or references is None:
            nodes, edges = graph.simulation_graph(papers.select("id"), references)
        else:
            nodes = graph.build_nodes(corpus.select("id"), papers)
            edges = graph.build_edges(references, nodes)
        self.nodes, self.edges = materialize(nodes), materialize(edges)
        if embeddings is None:
            embeddings = spark.createDataFrame([], "id bigint, embedding array<float>")
        parts = [
            features.neighbourhood_features(papers, self.edges, relevance_col), features.clustering(self.edges), centrality.pagerank(self.nodes, self.edges),
            centrality.betweenness(self.nodes, self.edges, self.pivots), centrality.closeness(self.nodes, self.edges), centrality.eigenvector(self.nodes, self.edges, on_no_convergence="return"),
            features.distance_to_relevant(papers, self.nodes, self.edges, relevance_col), features.semantic_features(papers, embeddings, relevance_col), features.metadata_features(papers),
        ]
        self.features_df = materialize(features.join_features(papers, parts))
        scaled = materialize(scores.standard_scale(self.features_df, features.FEATURES))
        found = [
            outliers.lof_embeddings(papers, embeddings), outliers.lof_network(scaled, features.FEATURES), outliers.lof_mixed(scaled, features.FEATURES, embeddings),
            isolation_forest(scaled.select("id", outliers.vector_of(features.FEATURES).alias("u")), seed=self.random_state),
        ]
        wide = materialize(reduce(lambda a, b: a.join(b, "id"), found, papers.select("id", F.col(relevance_col).alias("label_included"))))
        long = scores.to_long(wide, METHODS)
        ensemble = scores.reciprocal_rank_fusion(long) if self.use_rrf else scores.weighted_ensemble(long, self.weighting)
        self._scores = materialize(wide.join(ensemble, "id"))
        self._weights = scores.ensemble_weights(long, "uniform" if self.use_rrf else self.weighting)
        return self._scores

    def _fitted(self) -> DataFrame:
        if self._scores is None:
            raise ValueError("fit the detector first")
        return self._scores

    def scores(self) -> DataFrame:
        return self._fitted()

    def weights(self) -> DataFrame:
        self._fitted()
        return self._weights

    def network_statistics(self) -> DataFrame:
        self._fitted()
        return graph.network_stats(self.nodes, self.edges)

    def top_outliers(self, method: str = "ensemble", top_k: int | None = 10) -> DataFrame:
        return evaluation.top_outliers(self._fitted(), self.features_df, method, [*METHODS, "ensemble"], top_k)

    def method_comparison(self) -> DataFrame:
        return evaluation.method_comparison(self._fitted(), [*METHODS, "ensemble"])

    def detailed_breakdown(self, top_k: int = 10) -> DataFrame:
        return evaluation.detailed_breakdown(self._fitted(), METHODS, top_k)

    def subscores(self, document: int) -> DataFrame:
        return evaluation.document_subscores(self._fitted(), [*METHODS, "ensemble"], document)

    def document_analysis(self, document: int) -> DataFrame:
        return evaluation.document_analysis(self._fitted(), [*METHODS, "ensemble"], document)

    def known_outliers(self, known: DataFrame, method: str = "ensemble") -> DataFrame:
        return evaluation.known_outlier_ranks(self._fitted(), known, method)


def detect_outliers(papers: DataFrame, random_state: int = 42, **inputs) -> CitationOutlierDetector:
    """A fitted detector."""
    detector = CitationOutlierDetector(random_state)
    detector.fit(papers, **inputs)
    return detector


def analyze_datasets(papers: DataFrame, names: list[str], dataset_col: str = "dataset", **inputs) -> dict[str, CitationOutlierDetector | Exception]:
    """A fitted detector for each dataset, one after the other; an error stays with its own dataset. ``many.analyze_together`` scores all of them in one plan."""
    found: dict[str, CitationOutlierDetector | Exception] = {}
    for name in names:
        try:
            found[name] = detect_outliers(papers.where(F.col(dataset_col) == name), **inputs)
        except Exception as error:  # noqa: BLE001 - one dataset's failure is its result
            found[name] = error
    return found
