import math

import pytest

from corpusloom.operators import centrality, features, graph
from corpusloom.plans.components import connected_components

GRAPHS = {
    "path4": [(1, 2), (2, 3), (3, 4)], "star5": [(2, 1), (3, 1), (4, 1), (5, 1)], "two_cycle": [(1, 2), (2, 1)],
    "triangle_tail": [(1, 2), (2, 3), (3, 1), (3, 4)], "dup_self": [(1, 2), (1, 2), (1, 1)],
}


def build(spark, name, extra=()):
    refs = GRAPHS[name]
    ids = sorted({x for e in refs for x in e} | set(extra))
    nodes = graph.build_nodes(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame([(i,) for i in ids if i % 2], "id bigint"))
    return nodes, graph.build_edges(spark.createDataFrame(refs, "src bigint, dst bigint"), nodes)


def column(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def test_edges_and_nodes(spark):
    nodes, edges = build(spark, "dup_self", extra=[9])
    assert [tuple(r)[:3] for r in edges.collect()] == [(1, 2, 3.0)]
    assert {r["id"]: r["node_type"] for r in nodes.collect()} == {1: "simulation", 2: "background", 9: "simulation"}
    stats = graph.network_stats(nodes, edges).first()
    assert tuple(stats) == (3, 1, 2, 1, pytest.approx(1 / 6), False, 2)
    assert {r["pattern"]: r["n"] for r in graph.citation_patterns(nodes, edges).collect()} == {"sim_to_sim": 0, "sim_to_bg": 1, "bg_to_sim": 0}
    assert graph.missing_ids(spark.createDataFrame([(1,), (2,), (7,)], "id bigint"), nodes).count() == 2
    outside = graph.build_edges(spark.createDataFrame([(1, 77), (77, 1)], "src bigint, dst bigint"), nodes)
    assert outside.count() == 0


def test_fallback_graph_and_references(spark):
    papers = spark.createDataFrame([(1, [2, 2, 3]), (2, None), (4, [])], "id bigint, referenced_works array<bigint>")
    refs = graph.explode_references(papers)
    assert graph.simulation_graph(papers, refs)[1].count() == 1 and graph.simulation_graph(papers, None)[1].count() == 0
    empty = graph.network_stats(*(x.limit(0) for x in build(spark, "path4"))).first()
    assert (empty["nodes"], empty["density"], empty["connected"]) == (0, 0.0, False)


def test_degrees_and_neighbours(spark):
    papers = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 0)], "id bigint, label_included int")
    _, edges = build(spark, "two_cycle")
    got = {r["id"]: r for r in features.neighbourhood_features(papers, edges).collect()}
    assert (got[1]["degree"], got[2]["relevant_neighbors"], got[2]["relevant_ratio"], got[2]["mean_neighbor_degree"]) == (2, 1, 1.0, 2.0)
    assert got[9]["degree"] == 0 and got[9]["max_neighbor_degree"] == 0


def test_clustering(spark):
    assert column(features.clustering(build(spark, "triangle_tail")[1]), "clustering") == {1: 1.0, 2: 1.0, 3: pytest.approx(1 / 3), 4: 0.0}


def test_paths(spark):
    nodes, edges = build(spark, "path4", extra=[9])
    assert column(centrality.closeness(nodes, edges), "closeness") == pytest.approx({1: 0, 2: 1 / 4, 3: 2 / 3 * 2 / 4, 4: 3 / 6 * 3 / 4, 9: 0})
    assert column(centrality.closeness(nodes, edges, max_edges=0), "closeness") == pytest.approx(column(centrality.closeness(nodes, edges), "closeness"))
    assert column(centrality.betweenness(nodes, edges), "betweenness") == pytest.approx({1: 0, 2: 2 / 12, 3: 2 / 12, 4: 0, 9: 0})
    assert column(centrality.betweenness(nodes, edges, max_edges=1), "betweenness") == pytest.approx({1: 0, 2: 2 / 12, 3: 2 / 12, 4: 0, 9: 0})
    for refused in (centrality.betweenness, centrality.closeness):
        with pytest.raises(ValueError):
            refused(nodes, edges, max_edges=1, max_pairs=24)


def test_ranks(spark):
    nodes, edges = build(spark, "star5")
    rank = column(centrality.pagerank(nodes, edges), "pagerank")
    assert sum(rank.values()) == pytest.approx(1) and rank[1] > 3 * rank[2]
    nodes, edges = build(spark, "two_cycle")
    assert column(centrality.eigenvector(nodes, edges), "eigenvector") == pytest.approx({1: math.sqrt(0.5), 2: math.sqrt(0.5)})
    weighted = [(1, 2), (1, 2), (1, 3)]
    nodes = graph.build_nodes(spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), spark.createDataFrame([], "id bigint"))
    rank = column(centrality.pagerank(nodes, graph.build_edges(spark.createDataFrame(weighted, "src bigint, dst bigint"), nodes)), "pagerank")
    assert rank[2] > rank[3]
    assert centrality.pagerank(nodes.limit(0), build(spark, "path4")[1].limit(0)).count() == 0


def test_distance_leaves_the_paper_itself_out(spark):
    papers = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (9, 1)], "id bigint, label_included int")
    nodes, edges = build(spark, "path4")
    assert column(features.distance_to_relevant(papers, nodes, edges), "min_distance_to_relevant") == {1: 3.0, 2: 2.0, 3: 1.0, 4: 10.0, 9: 10.0}
    nodes, edges = build(spark, "triangle_tail")
    assert column(features.distance_to_relevant(papers, nodes, edges), "min_distance_to_relevant")[1] == 3.0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (8, 9), (9, 8), (None, 7)], [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)]])
def test_components(spark, edges):
    rep = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while rep[x] != x:
            x = rep[x]
        return x

    for a, b in edges:
        if None not in (a, b):
            ra, rb = find(a), find(b)
            rep[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in rep} and len(got) == len(rep)
