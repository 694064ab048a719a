import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import centrality, features, paths
from corpusloom.plans import arcs
from corpusloom.plans.materialize import release


def graph(spark, seed, n=60, m=170, hub=0):
    rnd = random.Random(seed)
    links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)} | {(7, i) for i in range(hub)}
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)], "id bigint")
    return nodes, spark.createDataFrame([(a, b, 1.0 + (a * b) % 3) for a, b in sorted(links) if a != b], "src bigint, dst bigint, weight double")


def column(df, name):
    return {r["id"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("batch_rows", [10**9, 1300])
def test_betweenness_by_joins_equals_that_in_tasks(spark, monkeypatch, batch_rows):
    monkeypatch.setattr(paths.joined_dependencies, "__defaults__", (None, batch_rows))
    nodes, edges = graph(spark, 1)
    inside, joined = centrality.betweenness(nodes, edges), centrality.betweenness(nodes, edges, max_edges=0)
    assert column(joined, "betweenness") == pytest.approx(column(inside, "betweenness"))
    pivots = nodes.where("id % 5 = 1")
    assert column(centrality.betweenness(nodes, edges, pivots, max_edges=0), "betweenness") == pytest.approx(column(centrality.betweenness(nodes, edges, pivots), "betweenness"))


def test_no_edges(spark):
    nodes, edges = graph(spark, 1)
    none = edges.limit(0)
    assert set(column(centrality.betweenness(nodes, none, max_edges=-1), "betweenness").values()) == {0.0}
    assert set(column(centrality.closeness(nodes, none, max_edges=-1), "closeness").values()) == {0.0}
    assert set(column(centrality.closeness(nodes, none, log_registers=8), "closeness").values()) == {0.0}


def test_closeness_by_counters_is_within_its_error(spark):
    nodes, edges = graph(spark, 2, n=400, m=1600)
    exact, guess = column(centrality.closeness(nodes, edges), "closeness"), column(centrality.closeness(nodes, edges, log_registers=12), "closeness")
    off = [abs(guess[i] - x) / x for i, x in exact.items() if x]
    assert {i for i, x in exact.items() if not x} == {i for i, x in guess.items() if not x}
    assert max(off) < 0.1 and sum(off) / len(off) < 0.03


@pytest.mark.parametrize("hub_arcs", [100_000, 8])
def test_arcs_are_read_without_a_shuffle(spark, monkeypatch, hub_arcs):
    monkeypatch.setattr(arcs, "HUB_ARCS", hub_arcs)
    nodes, edges = graph(spark, 3, hub=60)
    laid = arcs.Arcs(edges, "weight")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = laid.along(nodes, "id", "src", "weight")
        plan = sent._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    assert sorted(tuple(r) for r in sent.collect()) == sorted((b, a, w) for a, b, w in edges.collect())
    largest = laid.table.groupBy(*(c for c in ("src", "part") if c in laid.table.columns)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= (2 * hub_arcs if hub_arcs == 8 else 60)
    ranks = centrality.pagerank(nodes, edges, rounds=6)
    monkeypatch.setattr(arcs, "HUB_ARCS", 100_000)
    assert column(ranks, "pagerank") == pytest.approx(column(centrality.pagerank(nodes, edges, rounds=6), "pagerank"))


def test_rounds_of_ranks_do_not_sort_the_arcs(spark, monkeypatch):
    plans, kept, laid = [], centrality.observed, centrality.Arcs
    monkeypatch.setattr(centrality, "observed", lambda df, **m: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, **m))[1])
    sources = []
    monkeypatch.setattr(centrality, "Arcs", lambda edges, *columns: (sources.append(edges._jdf.queryExecution().executedPlan().toString()), laid(edges, *columns))[1])
    nodes, edges = graph(spark, 5, hub=30)
    ranks = column(centrality.pagerank(nodes, edges, rounds=2), "pagerank")
    centrality.eigenvector(nodes, edges, rounds=2).collect()
    rounds = [p for p in plans if "Bucketed: true" in p]
    assert len(rounds) == 4 and all("ShuffledHashJoin" in p and "Sort [src" not in p for p in rounds)
    assert len(sources) == 2 and not any("Join" in p for p in sources)  # no join of all arcs with their node's weight
    out, want = {}, {r["id"]: 1 / 63 for r in nodes.collect()}
    links = [tuple(r) for r in edges.collect()]
    for a, _, w in links:
        out[a] = out.get(a, 0) + w
    for _ in range(2):
        base = (0.85 * sum(r for i, r in want.items() if i not in out) + 0.15) / 63
        want, old = dict.fromkeys(want, base), want
        for a, b, w in links:
            want[b] += 0.85 * old[a] * w / out[a]
    assert ranks == pytest.approx(want)


@pytest.mark.parametrize("seed", range(2))
def test_distances_to_relevant_papers(spark, seed):
    nodes, edges = graph(spark, seed, n=40, m=70)
    papers = nodes.withColumn("label_included", (F.col("id") % 9 == 1).cast("int"))
    near = {}
    for a, b, _ in edges.collect():
        near.setdefault(a, set()).add(b)
    want = {}
    for i in range(43):
        front, seen, d, want[i] = {i}, {i}, 0, 10.0
        while front:
            front, d = {y for x in front for y in near.get(x, ())} - seen, d + 1
            seen |= front
            if any(x % 9 == 1 for x in front):
                want[i] = float(d)
                break
    assert column(features.distance_to_relevant(papers, nodes, edges), "min_distance_to_relevant") == want


def test_a_node_hears_one_row_of_fixed_size_whatever_the_sources(spark, monkeypatch):
    """A hub cites 300 sources: the frontier has one row a node, and a round neither sorts arcs nor groups pairs of nodes and sources."""
    rows, kept = [], features.observed
    monkeypatch.setattr(features, "observed", lambda df, **m: (rows.append((df._jdf.queryExecution().executedPlan().toString(), df.columns)), kept(df, **m))[1])
    links = [(1000, i) for i in range(300)] + [(1001, 1000), (1002, 1001), (7, 1002), (1003, 7)]
    edges = spark.createDataFrame(links, "src bigint, dst bigint")
    papers = spark.createDataFrame([(i, int(i < 300)) for i in [*range(300), *range(1000, 1004)]], "id bigint, label_included int")
    got = column(features.distance_to_relevant(papers, papers, edges), "min_distance_to_relevant")
    assert got == {i: 10.0 for i in range(300)} | {1000: 1.0, 1001: 2.0, 1002: 3.0, 7: 4.0, 1003: 1.0}
    assert len(rows) == 6 and all(columns == ["id", "one", "two", "d"] for _, columns in rows)
    for plan, _ in rows:
        assert "keys=[dst" in plan and "ShuffledHashJoin" in plan and "LeftAnti" not in plan
    assert not any("one#" in line.split("functions=")[0] for plan, _ in rows for line in plan.splitlines() if "HashAggregate(keys" in line)


def test_tables_are_released(spark):
    arcs.Arcs(graph(spark, 4)[1])
    assert any(t.name.startswith("corpusloom_") for t in spark.catalog.listTables())
    assert release(spark) > 0
    assert not any(t.name.startswith("corpusloom_") for t in spark.catalog.listTables())
