import json

import numpy as np
import pytest

from corpusloom.operators.detector import CitationOutlierDetector, analyze_datasets
from corpusloom.operators.features import FEATURES, semantic_features
from corpusloom.plans.materialize import materialize, release
from corpusloom.sources import datasets

CONFIG = {"one": {"outlier_ids": [3, 1], "original_rank": 5, "simulation_file": "one.csv", "embeddings_filename": "one.npy", "embeddings_metadata_filename": "one.json"}, "bare": {}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "datasets.json").write_text(json.dumps(CONFIG))
    (tmp_path / "one.csv").write_text('record_id,openalex_id,doi,title,abstract,label_included\n0,W0,,"A ""quoted"", title\nin two lines",x,1\n1,W1,,B,,0\n')
    np.save(tmp_path / "one.npy", np.array([[1, 2], [np.nan, 0], [3, 4]], np.float32))
    (tmp_path / "one.json").write_text(json.dumps({"documents": [{"openalex_id": "a"}, {"openalex_id": "b"}, {"openalex_id": "a"}]}))
    return str(tmp_path)


def test_configuration_and_papers(spark, folder):
    config = datasets.load_config(spark, f"{folder}/datasets.json")
    assert datasets.dataset_names(config) == ["one", "bare"]
    rows = datasets.load_papers(spark, config, "one", folder).orderBy("record_id").collect()
    assert rows[0]["title"] == 'A "quoted", title\nin two lines' and rows[0]["label_included"] == 1 and len(rows) == 2
    for name in ("two", "bare"):
        with pytest.raises(ValueError):
            datasets.load_papers(spark, config, name, folder)
    with pytest.raises(FileNotFoundError):
        datasets.load_config(spark, f"{folder}/none.json")
    assert datasets.validate(spark, config, "one", folder) and not datasets.validate(spark, config, "bare", folder)
    assert datasets.availability(spark, config, "one", folder) == {"simulation_data": True, "embeddings": True, "embeddings_metadata": True}
    assert datasets.outlier_ids(spark, config, "one").collect()[0]["record_id"] == 3 and datasets.outlier_ids(spark, config, "x").count() == 0
    assert datasets.list_datasets(spark, folder) == ["one"] and datasets.resolve_dataset(spark, "one", folder).count() == 2
    with pytest.raises(FileNotFoundError):
        datasets.resolve_dataset(spark, "missing", folder)


def test_embeddings_and_metadata(spark, folder):
    rows, _ = datasets.load_embeddings(spark, f"{folder}/one.npy", f"{folder}/one.json")
    assert {r["id"]: r["embedding"] for r in rows.collect()} == {"a": [3.0, 4.0], "b": None}
    assert datasets.load_embeddings(spark, f"{folder}/one.npy", f"{folder}/no.json") == (None, None)
    legacy = spark.createDataFrame([(["x", "y", "x"],)], "openalex_id array<string>")
    assert {r["openalex_id"]: r["index"] for r in datasets.id_index(legacy).collect()} == {"x": 2, "y": 1}
    shown, totals = datasets.embedding_summary(rows.withColumn("title", rows["id"]), ["title"])
    row = totals.first()
    assert (row["num_documents"], row["valid_embeddings"], row["mean_norm"], row["std_norm"]) == (2, 1, 5.0, 0.0) and shown.where("has_embedding").count() == 1


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 200, [1.0, 0.0])], "id bigint, title string, embedding array<float>")
    datasets.save_embeddings(df, str(tmp_path / "e"), ["title"])
    assert spark.read.parquet(str(tmp_path / "e/vectors")).first()["title"] == "x" * 100
    datasets.save_results({"a": df.select("id")}, str(tmp_path / "r"))
    assert datasets.load_results(spark, str(tmp_path / "r"), ["a"])["a"].first()["id"] == 1
    datasets.save_report(df.select("id"), str(tmp_path / "c"))
    assert datasets.load_csv(spark, str(tmp_path / "c")).first()["id"] == "1" and datasets.load_csv(spark, str(tmp_path / "zz")) is None
    assert "id: 1" in datasets.text_report(df.select("id"), "Title") and datasets.load_corpus(spark, str(tmp_path / "zz")) is None
    (tmp_path / "d.csv").write_text("Paper Title,The Abstract\na,b\nc,d\n")
    named = datasets.load_documents(spark, str(tmp_path / "d.csv"), 1)
    assert named.columns == ["title", "abstract"] and named.count() == 1
    assert [r["record_id"] for r in datasets.with_record_ids(datasets.load_documents(spark, str(tmp_path / "d.csv")), "title").orderBy("title").collect()] == [0, 1]
    got = datasets.encode(spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, text string"), datasets.hashing_encoder).orderBy("id").collect()
    assert sum(x * x for x in got[0]["embedding"]) == pytest.approx(1) and got[1]["embedding"] is None


def test_semantic_defaults(spark):
    papers = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id bigint, label_included int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id bigint, embedding array<float>")
    got = {r["id"]: tuple(r)[1:] for r in semantic_features(papers, vectors).collect()}
    assert got[1] == (0.0, 1.0, 0.0) == got[3] and got[2] == pytest.approx((0.70710678, 0.29289322, 0.70710678))
    assert semantic_features(papers.selectExpr("id", "0 as label_included"), vectors).first()[1] == 0.0


@pytest.mark.parametrize("rrf", [False, True])
def test_detector_end_to_end(spark, rrf):
    detector = CitationOutlierDetector(use_rrf=rrf)
    with pytest.raises(ValueError):
        detector.top_outliers()
    papers = spark.createDataFrame([(i, f"title {i}", int(i % 9 == 0)) for i in range(40)], "id bigint, title string, label_included int")
    refs = spark.createDataFrame([(i, (i * 7 + 1) % 40) for i in range(40)] + [(i, (i + 1) % 40) for i in range(0, 40, 2)] + [(0, 99)], "src bigint, dst bigint")
    corpus = spark.range(45).selectExpr("id")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(30)], "id bigint, embedding array<float>")
    out = detector.fit(papers, refs, corpus, vectors)
    assert out.count() == 40 and detector.features_df.columns == ["id", *FEATURES]
    assert sum(r["weight"] for r in detector.weights().collect()) == pytest.approx(1)
    top = detector.top_outliers(top_k=5).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0]["outlier_score"] == max(r["ensemble"] for r in out.collect())
    assert detector.method_comparison().count() == 5 and detector.detailed_breakdown(3).count() == 3 and detector.document_analysis(7).count() == 5
    assert detector.network_statistics().first()["nodes"] == 45 and detector.known_outliers(papers.where("id = 9")).count() == 1 and detector.subscores(3).count() == 1


def test_one_datasets_error_stays_its_own(spark):
    papers = spark.createDataFrame([(i, "t", 0, "a" if i else "b") for i in range(12)], "id bigint, title string, label_included int, dataset string")
    found = analyze_datasets(papers, ["a"], references="not a table")
    assert isinstance(found["a"], Exception)


def test_release_deletes_what_was_written(spark):
    from pathlib import Path

    df = materialize(spark.range(5))
    path = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert path.exists() and release(spark) >= 1 and not path.exists()


def test_datasets_of_the_collection_and_reports_that_are_too_long(spark, tmp_path):
    for path, n in (("synergy/Known_2020", 2), ("synergy/other", 3), ("Plain_2021", 4)):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / f"{path}.csv").write_text("a\n" + "1\n" * n)
    config = {"known": {"synergy_dataset_name": "Known_2020"}, "plain": {"synergy_dataset_name": "Plain_2021"}}
    found = {name: datasets.resolve_dataset(spark, name, str(tmp_path), config).count() for name in ("known", "other", "synergy:other", "plain", "Plain_2021")}
    assert found == {"known": 2, "other": 3, "synergy:other": 3, "plain": 4, "Plain_2021": 4}
    with pytest.raises(FileNotFoundError):
        datasets.resolve_dataset(spark, "synergy:none", str(tmp_path), config)
    assert datasets.text_report(spark.range(1000), "T").count("id:") == 1000
    with pytest.raises(ValueError):
        datasets.text_report(spark.range(1001), "T")
    flat = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2), (None, 3)], "openalex_id string, index int")
    assert {r["openalex_id"]: r["index"] for r in datasets.id_index(flat).collect()} == {"x": 2, "y": 1}
