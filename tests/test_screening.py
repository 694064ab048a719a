import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import screening
from corpusloom.streaming.stopping import stream_stopping, windowed_counts


def stop_at(labels, patience):
    run = -1
    for i, y in enumerate(labels, 1):
        run = 0 if y else run + 1 if run >= 0 else -1
        if run >= patience:
            return i
    return len(labels)


def log_of(spark, labels):
    return spark.createDataFrame([(1000 - i, y, i) for i, y in enumerate(labels)], "record_id bigint, label int, time bigint")


@pytest.mark.parametrize("labels,patience", [([0, 0, 0, 0], 2), ([0, 1, 0, 1, 0, 0, 0], 2), ([1, 0, 0], 2), ([1, 0, 1, 0], 2), ([1], 1)])
def test_stopping_rule(spark, labels, patience):
    assert screening.stopping_point(log_of(spark, labels), patience).first()["reviewed"] == stop_at(labels, patience)


def test_stopping_rule_on_random_logs(spark):
    rnd = random.Random(0)
    for _ in range(5):
        labels = [int(rnd.random() < 0.1) for _ in range(200)]
        assert screening.stopping_point(log_of(spark, labels), 12).first()["reviewed"] == stop_at(labels, 12)


def test_exports_and_curves(spark):
    labels = [0, 1, 0, 0, 1, 0]
    seen = screening.reviewed_prefix(log_of(spark, labels), 2)
    papers = spark.createDataFrame([(1000 - i, f"W{i}", None, y) for i, y in enumerate(labels)], "record_id bigint, openalex_id string, title string, label_included int")
    enriched = screening.enrich(papers, seen)
    assert {r["record_id"]: r["review_order"] for r in enriched.collect()} == {1000: 0, 999: 1, 998: 2, 997: 3, 996: -1, 995: -1}
    assert sorted((r["record_id"], r["label_included"], r["title"]) for r in screening.leftover_documents(enriched).collect()) == [(995, 0, ""), (996, 0, ""), (999, 1, "")]
    assert [r["openalex_id"] for r in screening.found_documents(enriched).collect()] == ["https://openalex.org/W1"]
    truth = sorted(screening.leftover_with_truth(enriched).collect(), key=lambda r: r["position"])
    assert [(r["record_id"], r["label_included"], r["asreview_label"]) for r in truth] == [(999, 1, 1), (995, 0, None), (996, 1, None)]
    ranks = screening.leftover_ranks(log_of(spark, labels), spark.createDataFrame([(996,), (999,)], "record_id bigint"), 2)
    assert {tuple(r) for r in ranks.collect()} == {(996, 5, 2, 1, 3), (999, 2, -1, -1, -1)}
    curve = screening.recall_curve(log_of(spark, labels))
    assert [r["recall"] for r in screening.extend_curve(curve, 8).orderBy("position").collect()] == [0, 0.5, 0.5, 0.5, 1, 1, 1, 1]
    order = sorted(screening.reranked_order(log_of(spark, labels), spark.createDataFrame([(996,)], "record_id bigint"), 2, 2).collect(), key=lambda r: r["position"])
    assert [r["record_id"] for r in order] == [1000, 999, 998, 997, 995, 996]


def test_split_sample_and_labels(spark):
    papers = spark.range(100).select("id", (F.col("id") % 20 == 0).cast("int").alias("label_included"))
    split = screening.stratified_split(papers)
    assert {(r["label_included"], r["is_test"]): r["count"] for r in split.groupBy("label_included", "is_test").count().collect()} == {(1, True): 1, (1, False): 4, (0, True): 19, (0, False): 76}
    assert [r["id"] for r in screening.sample_documents(papers, 2, 3).collect()] == [0, 20, 1, 2, 3]
    screening.check_labels(papers, "label_included")
    with pytest.raises(ValueError):
        screening.check_labels(papers.where("label_included = 1"), "label_included")


@pytest.mark.parametrize("learner", ["nb", "svm"])
def test_simulated_review_finds_relevant_papers_first(spark, learner):
    rows = [(i, "special topic" if i % 10 == 3 else "common words", f"about item {i % 7}", int(i % 10 == 3)) for i in range(120)]
    got = sorted(screening.simulate_review(spark.createDataFrame(rows, "id bigint, title string, abstract string, label_included int"), learner, batch=11, rounds=1).collect(), key=lambda r: r["review_order"])
    assert [r["id"] for r in got[:4]] == [0, 1, 2, 3] and sum(r["label"] for r in got[4:]) == 11


@pytest.mark.parametrize("learner", ["svm", "lr"])
def test_models_are_sent_to_tasks_after_something_was_observed(spark, learner):
    from corpusloom.plans.materialize import observed

    observed(spark.range(3).toDF("id"), n=F.count("*"))
    rows = [(i, "special topic" if i % 10 == 3 else "common words", "text", int(i % 10 == 3)) for i in range(60)]
    assert screening.simulate_review(spark.createDataFrame(rows, "id bigint, title string, abstract string, label_included int"), learner, batch=11, rounds=1).count() >= 15


@pytest.mark.parametrize("patience,everything", [(30, False), (1000, True)])
def test_simulated_review_goes_on_until_the_rule_fires(spark, patience, everything):
    rows = [(i, "special topic" if i % 10 == 3 else "common words", f"about item {i % 7}", int(i % 10 == 3)) for i in range(400)]
    papers = spark.createDataFrame(rows, "id bigint, title string, abstract string, label_included int")
    got = sorted(screening.simulate_review(papers, batch=7, patience=patience).collect(), key=lambda r: r["review_order"])
    labels = [r["label"] for r in got]
    assert sum(labels) == 40 and [r["review_order"] for r in got] == list(range(len(got))) and len({r["id"] for r in got}) == len(got)
    assert len(got) == stop_at(labels, patience) == (400 if everything else 4 + 39 + patience)


def test_simulated_review_reads_all_of_one_class(spark):
    papers = spark.createDataFrame([(i, "title", "text", 0) for i in range(150)], "id bigint, title string, abstract string, label_included int")
    assert sorted((r["review_order"], r["id"]) for r in screening.simulate_review(papers).collect()) == [(i, i) for i in range(150)]


@pytest.mark.parametrize("run", [0, 3])
def test_stop_within_a_batch_equals_record_by_record(spark, run):
    rnd = random.Random(run)
    for patience in (4, 9):
        labels = [float(rnd.random() < 0.2) for _ in range(40)]
        whole = [1, *[0] * run, *map(int, labels)]
        best = spark.createDataFrame([(i, float(i), y) for i, y in enumerate(labels)], "id bigint, key double, y double")
        rows, n, tail = screening._read_until_stop(best, run, patience)
        assert rows.count() == n == stop_at(whole, patience) - 1 - run
        assert tail == next(j for j, y in enumerate(whole[: n + 1 + run][::-1]) if y)


def test_streams(spark, tmp_path):
    labels = [0, 1, 0, 0, 0, 0]
    rows = [(r, t, y) for r in (1, 2) for t, y in enumerate(labels if r == 1 else [1, 0, 1])]
    spark.createDataFrame(rows, "reviewer bigint, time bigint, label int").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("reviewer bigint, time bigint, label int").parquet(str(tmp_path / "in"))
    run = stream_stopping(source, 3).writeStream.format("memory").queryName("stopping").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("stopping").collect()} == {(1, 5, True), (2, 3, False)}
    events = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts, 'a' as event_type, 2.0 as value union all select timestamp_ntz'2024-01-01 01:10:00', 'a', 3.0")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    run = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["total"] for r in spark.table("counts").collect()) == [2.0, 3.0]


def test_review_up_to_the_last_relevant_record(spark):
    rows = [(i, "special topic" if i % 10 == 3 else "common words", f"about item {i % 7}", int(i % 10 == 3)) for i in range(300)]
    papers = spark.createDataFrame(rows, "id bigint, title string, abstract string, label_included int")
    for settings in ("plain", "tuned"):
        got = sorted(screening.simulate_review(papers, batch=20, stopper="last_relevant", settings=settings).collect(), key=lambda r: r["review_order"])
        assert sum(r["label"] for r in got) == 30 and got[-1]["label"] == 1
    assert screening.simulate_review(papers, batch=200, patience=-1).count() == 300
    with pytest.raises(ValueError):
        screening.simulate_review(papers, stopper="never")


def test_review_vectors_drop_common_terms_and_know_runs(spark):
    texts = spark.createDataFrame([(i, 0.0, f"common word{i}" + (" pair here" if i < 2 else " here pair")) for i in range(10)], "id bigint, y double, text string")
    plain, tuned = ({r["id"]: r["x"] for r in screening.review_vectors(texts, 1 << 12, *s).collect()} for s in ((1, 1.0), (2, 0.95)))
    assert all(plain[0][i] == plain[5][i] for i in map(int, set(plain[0].indices) & set(plain[5].indices)))
    assert tuned[0].squared_distance(tuned[1]) < tuned[0].squared_distance(tuned[5]) and (tuned[0].toArray() > 0).sum() < len(tuned[0].indices)
