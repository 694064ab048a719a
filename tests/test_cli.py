import json

from corpusloom.__main__ import main


def test_commands(spark, tmp_path, capsys):
    rows = [(i, f"title {i} {'rare' if i % 6 == 0 else 'plain'}", "text", int(i % 6 == 0)) for i in range(30)]
    spark.createDataFrame(rows, "id bigint, title string, abstract string, label_included int").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "src bigint, dst bigint").write.parquet(str(tmp_path / "r"))
    paths = {k: str(tmp_path / k) for k in ("p", "r", "a", "v", "e")}
    assert main(["analyze", paths["p"], paths["a"], "--references", paths["r"], "--rrf", "--top-k", "3"], spark) == 0
    assert spark.read.parquet(f"{paths['a']}/scores").count() == 30 and "Methods" in capsys.readouterr().out
    assert main(["review", paths["p"], paths["v"], "--rounds", "1", "--batch", "5"], spark) == 0 and "reviewed" in capsys.readouterr().out
    assert main(["encode", paths["p"], paths["e"]], spark) == 0 and spark.read.parquet(f"{paths['e']}/vectors").count() == 30
    (tmp_path / "c.json").write_text(json.dumps({"x": {"simulation_file": "none.csv"}}))
    assert main(["validate", str(tmp_path / "c.json"), str(tmp_path)], spark) == 1 and "x: not usable" in capsys.readouterr().out


def test_commands_on_logs_and_scores(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 7 == 0), i) for i in range(50)], "record_id bigint, label int, time bigint").write.parquet(str(tmp_path / "log"))
    spark.createDataFrame([(i, "d", i % 2, i / 50) for i in range(50)], "id bigint, dataset string, label_included int, ensemble double").write.parquet(str(tmp_path / "scores"))
    spark.createDataFrame([(i, i % 3) for i in range(50)], "id bigint, degree bigint").write.parquet(str(tmp_path / "features"))
    paths = {k: str(tmp_path / k) for k in ("log", "scores", "features", "a", "b", "c")}
    assert main(["ranks", paths["log"], paths["a"], "--targets", "49", "35", "--patience", "5"], spark) == 0
    assert main(["recall", paths["log"], paths["b"]], spark) == 0 and main(["describe", paths["scores"], paths["features"], paths["c"]], spark) == 0
    read = lambda k: spark.read.option("header", True).csv(paths[k])
    assert {r["record_id"] for r in read("a").collect()} == {"49", "35"} and read("b").count() == 50 and read("c").first()["documents"] == "50"
