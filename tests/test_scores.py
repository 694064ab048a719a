import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns
from corpusloom.functions.vectors import cosine, euclidean, unit
from corpusloom.operators import evaluation, knn, outliers, reporting, scores
from corpusloom.operators.iforest import average_path, isolation_forest
from corpusloom.plans.order import running_sum, with_position


def frame(spark, **methods):
    n = len(next(iter(methods.values())))
    return spark.createDataFrame([(i, i % 2, *(float(v[i]) for v in methods.values())) for i in range(n)], "id bigint, label_included int, " + ", ".join(f"{m} double" for m in methods))


def values(df, name="value"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_normalisations_of_constant_scores(spark):
    long = scores.to_long(frame(spark, a=[2, 2, 2]), ["a"])
    assert values(scores.normalize(long, "minmax")) == [0, 0, 0] == values(scores.normalize(long, "zscore"))
    assert values(scores.normalize(long, "rank")) == pytest.approx([2 / 3] * 3)
    with pytest.raises(ValueError):
        scores.normalize(long, "other")


def test_quantile_transform_interpolates_on_large_inputs(spark):
    x = np.random.default_rng(0).random(1500)
    got = np.array(values(scores.quantile_transform(scores.to_long(frame(spark, a=x), ["a"]))))
    assert got.min() == 0 and got.max() == 1 and np.abs(got - np.argsort(np.argsort(x)) / 1499).max() < 0.002


def test_rank_conventions_on_ties(spark):
    got = scores.tie_ranks(scores.to_long(frame(spark, a=[5, 7, 5, 1]), ["a"])).orderBy("id").collect()
    assert [(r["r_ord"], r["r_min"], r["r_max"], r["r_avg"]) for r in got] == [(2, 2, 3, 2.5), (1, 1, 1, 1.0), (3, 2, 3, 2.5), (4, 4, 4, 4.0)]


def test_weights_and_ensembles(spark):
    wide = frame(spark, a=[0, 1, 0, 1], b=[3, 3, 3, 3])
    long = scores.to_long(wide, ["a", "b"])
    assert {r["method"]: r["weight"] for r in scores.ensemble_weights(long).collect()} == {"a": 1.0, "b": 0.0}
    assert {r["weight"] for r in scores.ensemble_weights(scores.to_long(wide, ["b"])).collect()} == {1.0}
    assert values(scores.weighted_ensemble(long), "ensemble") == [0, 1, 0, 1]
    assert values(scores.reciprocal_rank_fusion(scores.to_long(wide, ["a"])), "ensemble") == pytest.approx([1 / 63, 1 / 61, 1 / 64, 1 / 62])
    with pytest.raises(ValueError):
        scores.ensemble_weights(long, "other")


def test_positions_and_running_sums_over_many_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    assert all(r["k"] == r["position"] for r in with_position(rows, F.col("k")).collect())
    got = sorted(running_sum(rows, "v", F.col("k")).collect(), key=lambda r: r["k"])
    assert [r["running"] for r in got] == np.cumsum([r["v"] for r in got]).tolist() and [r["position"] for r in got] == list(range(1000))
    assert running_sum(rows.limit(0), "v", F.col("k")).count() == 0


def test_lof_small_and_even_inputs(spark):
    grid = [(i * 10 + j, [float(i), float(j)]) for i in range(10) for j in range(10)]
    lof = {r["id"]: r["lof"] for r in knn.local_outlier_factor(spark.createDataFrame([*grid, (500, [40.0, 40.0])], "id bigint, u array<double>"), "euclidean", block=16).collect()}
    assert lof[500] == max(lof.values()) > 5 and abs(lof[55] - 1) < 0.1
    assert knn.neighbour_count(2) == 1 and knn.neighbour_count(5) == 3 and knn.neighbour_count(100) == 10
    assert [r["lof"] for r in knn.local_outlier_factor(spark.createDataFrame([(1, [1.0])], "id bigint, u array<double>"), "euclidean").collect()] == [1.0]
    pair = knn.local_outlier_factor(spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id bigint, u array<double>"), "euclidean").collect()
    assert [r["lof"] for r in pair] == pytest.approx([1.0, 1.0])
    with pytest.raises(ValueError):
        knn.distances(np.zeros((1, 1)), np.zeros((1, 1)), "other")


def test_missing_embeddings_score_zero_and_mixed_falls_back(spark):
    papers = spark.createDataFrame([(i, 0) for i in range(6)], "id bigint, label_included int")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)] + [(4, [float("nan"), 1.0]), (5, None)], "id bigint, embedding array<float>")
    got = {r["id"]: r["lof_embeddings"] for r in outliers.lof_embeddings(papers, vectors).collect()}
    assert got[4] == got[5] == 0 and all(got[i] > 0 for i in range(4))
    scaled = papers.select("id", F.col("id").cast("double").alias("f"))
    none = vectors.limit(0)
    assert sorted(r["lof_mixed"] for r in outliers.lof_mixed(scaled, ["f"], none).collect()) == sorted(r["lof_network"] for r in outliers.lof_network(scaled, ["f"]).collect())


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(400)] + [(999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id bigint, u array<double>")
    a, b = ({r["id"]: r["isolation_forest"] for r in isolation_forest(x).collect()} for x in (df, df.repartition(7)))
    assert a == b and max(a, key=a.get) == 999 and all(-0.5 < v < 0.5 for v in a.values()) and average_path(256) == pytest.approx(10.24, abs=0.01)
    assert isolation_forest(df.limit(1)).first()["isolation_forest"] == 0.0


def test_evaluation_edges(spark):
    wide = frame(spark, ensemble=[0.9, 0.2, 0.8, 0.1])
    row = evaluation.threshold_metrics(wide.withColumn("label_included", F.lit(0)), "ensemble", "label_included", 0.5).first()
    assert (row["tp"], row["precision"], row["recall"], row["f1"], row["auc"]) == (0, 0, 0, 0, 0)
    best = evaluation.best_threshold(evaluation.threshold_sweep(wide.withColumn("label_included", F.lit(0)), "ensemble", "label_included")).first()
    assert tuple(best) == (0.5, 0.0)
    with pytest.raises(ValueError):
        evaluation.top_outliers(wide, wide, "other", ["ensemble"])
    with pytest.raises(ValueError):
        evaluation.document_subscores(wide, ["ensemble"], 77)
    assert evaluation.document_subscores(wide, ["ensemble"], 2).first()["ensemble"] == 0.8
    assert evaluation.convert_record_ids(spark.createDataFrame([(0, 1)], "position long, record_id long"), wide).count() == 0


def test_published_rank_arithmetic(spark):
    """Rank 41 of 691 after 399, and the budgets of the three corpora."""
    n = 691
    wide = spark.range(n).select("id", (F.lit(n) - F.col("id")).cast("double").alias("ensemble"))
    row = evaluation.rank_improvement(wide, ["ensemble"], spark.createDataFrame([(40, 399)], "id bigint, original_rank bigint")).first()
    assert (row["new_rank"], row["rank_improvement"]) == (41, 358) and row["relative_improvement_percent"] == pytest.approx(89.72, abs=0.01) and row["new_percentile"] == pytest.approx(94.07, abs=0.01)
    table = reporting.topk_budget_table(spark.createDataFrame([("a", 691, 399), ("b", 2433, 2240), ("c", 8396, 3692)], "dataset string, documents bigint, original_rank bigint")).orderBy("dataset").collect()
    assert [(r["top_1"], r["top_5"], r["top_10"], round(r["efficiency"], 1), r["grade"]) for r in table] == [(6, 34, 69, 98.7, "A+"), (24, 121, 243, 99.0, "A+"), (83, 419, 839, 97.8, "A+")]


def test_columns(spark):
    row = spark.range(1).select(
        columns.canonical_openalex(F.lit("W1")), columns.canonical_openalex(F.lit("7")), columns.canonical_openalex(F.lit("")), columns.canonical_openalex(F.lit("https://x")), columns.embedding_text(F.lit(" "), F.lit(None)),
        columns.embedding_text(F.lit(" a "), F.lit(None)), columns.title_abstract(F.lit(None), F.lit("b")), columns.finite_or_zero(F.lit(float("inf"))), columns.clamp_infinite(F.lit(float("-inf"))), columns.display_name(F.lit("mean_neighbor_degree_of_all")),
    ).first()
    assert tuple(row) == ("https://openalex.org/W1", "https://openalex.org/W7", "", "https://x", None, "a[SEP]", " b", 0.0, -1e6, "Mean Neighb. Degr...")
    dirty = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    assert sorted(r["x"] for r in columns.clean_with_statistics(dirty, "x").collect()) == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]
    assert columns.resolve_label(spark.createDataFrame([(1, 2)], "label int, relevant int")) == "label"
    with pytest.raises(ValueError):
        columns.resolve_label(dirty)


def test_vectors(spark):
    a, b, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(cosine(a, b), cosine(a, zero), euclidean(a, zero), unit(zero), unit(a)).first()
    assert tuple(row) == (0.96, 0.0, 5.0, [0.0, 0.0], [0.6, 0.8])


@pytest.mark.parametrize("n", [40, 700])
def test_isolation_forest_equals_row_by_row(spark, n):
    """Draws, trees and depths followed one row at a time."""
    from corpusloom.operators.iforest import average_path, grow, isolation_forest

    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 3)).round(3)
    x[0] = 9
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id bigint, u array<double>")
    trees, psi = 12, min(256, n)
    draws = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("h", F.xxhash64(F.lit(42), "tree", "id")).collect()
    depth, total = int(np.ceil(np.log2(psi))), np.zeros(n)
    for tree in range(trees):
        own = [i for _, i in sorted((r["h"], r["id"]) for r in draws if r["tree"] == tree)[:psi]]
        nodes = grow(x[own], depth, np.random.default_rng([42, tree]))
        for i in range(n):
            f, t, left, right, d = nodes[0]
            while f >= 0:
                f, t, left, right, d = nodes[left if x[i, f] <= t else right]
            total[i] += d
    expected = 2.0 ** (-total / trees / average_path(psi)) - 0.5
    got = {r["id"]: r["isolation_forest"] for r in isolation_forest(rows, trees=trees).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(expected.tolist()) and max(got, key=got.get) == 0
    harmonic = sum(1 / k for k in range(1, psi))
    assert average_path(psi) == pytest.approx(2 * harmonic - 2 * (psi - 1) / psi, abs=1.01 / (psi - 1))  # the logarithm falls short of the sum by half of 1 / (psi - 1)


def test_importance_goes_to_what_decides(spark):
    from corpusloom.operators.reporting import feature_importance

    rng = np.random.default_rng(5)
    x = rng.random((300, 3))
    y = 3 * (x[:, 1] > 0.5) + (x[:, 2] > 0.7)
    frame = spark.createDataFrame([(float(t), float("inf") if i == 0 else float(a), float(b), float(c)) for i, (t, (a, b, c)) in enumerate(zip(y, x))], "y double, noise double, strong double, weak double")
    got = {r["feature"]: r["importance"] for r in feature_importance(frame, "y", ["noise", "strong", "weak"], trees=20).collect()}
    # the share of variance that each explains
    assert sum(got.values()) == pytest.approx(1) and got["strong"] == pytest.approx(2.25 / (2.25 + 0.21), abs=0.05) and got["noise"] < 0.02 < got["weak"]


def test_top_features_table_fills_with_zero(spark):
    from corpusloom.operators.reporting import top_features_table

    rows = [("a", "x_one", 0.5), ("a", "y", 0.3), ("a", "z", 0.2), ("b", "x_one", 0.1), ("b", "y", 0.0), ("b", "z", 0.9), ("c", "w", 1.0)]
    got = top_features_table(spark.createDataFrame(rows, "dataset string, feature string, importance double"), ["a", "b"], 2).collect()
    assert {(r["feature"], r["a"], r["b"], r["display"], r["greatest"]) for r in got} == {("x_one", 50.0, 10.0, "X One", 50.0), ("y", 30.0, 0.0, "Y", 30.0), ("z", 0.0, 90.0, "Z", 90.0)}


def test_neighbours_merge_in_rounds(spark, monkeypatch):
    from corpusloom.operators import knn

    monkeypatch.setattr(knn, "MERGED", 2)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 2)).round(2)
    got = knn.nearest(spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "id bigint, u array<double>"), 4, "euclidean", block=2).collect()
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 12)
    np.fill_diagonal(d, np.inf)
    assert {(r["id"], r["nb"]) for r in got} == {(i, int(j)) for i in range(90) for j in np.argsort(d[i], kind="stable")[:4]}
