import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import datasets, npy


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i8", ">f4"])
def test_a_file_is_read_in_ranges(spark, tmp_path, kind):
    x = np.random.default_rng(1).normal(size=(5000, 7)).astype(kind)
    if x.dtype.kind == "f":
        x[[3, 4999], 2] = np.nan
    np.save(tmp_path / "x.npy", x)
    rows = datasets.read_npy(spark, f"{tmp_path}/x.npy", range_bytes=700 * x.dtype.itemsize * 7)
    assert rows.rdd.getNumPartitions() == 8
    got = {r["index"]: r["embedding"] for r in rows.collect()}
    assert len(got) == 5000
    for i in (0, 699, 700, 4998):
        assert got[i] == x[i].astype("<f4").tolist()
    assert [i for i in got if got[i] is None] == ([3, 4999] if x.dtype.kind == "f" else [])
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) == 700


def test_headers(tmp_path):
    with pytest.raises(ValueError):
        npy.parse_header(b"")
    for bad in (np.zeros(3), np.asfortranarray(np.zeros((3, 2))), np.array([["a", "b"]])):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(ValueError):
            npy.read_header(f"file:{tmp_path}/bad.npy")
    np.save(tmp_path / "ok.npy", np.zeros((0, 4), np.float32))
    assert npy.read_header(f"{tmp_path}/ok.npy").rows == 0


def test_broken_files_are_none(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"openalex_id": ["a", "b"]}')
    np.save(tmp_path / "x.npy", np.ones((2, 3), np.float32))
    whole = (tmp_path / "x.npy").read_bytes()
    assert datasets.load_embeddings(spark, f"{tmp_path}/x.npy", f"{tmp_path}/m.json")[0].count() == 2
    for broken in (b"", whole[:40], b"\x93NUMPY\x01\x00\x10\x00{'descr': oops  }", whole[:-4]):
        (tmp_path / "x.npy").write_bytes(broken)
        assert datasets.load_embeddings(spark, f"{tmp_path}/x.npy", f"{tmp_path}/m.json") == (None, None)


def test_empty_matrix_and_whole_files(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 4), np.float32))
    assert datasets.read_npy(spark, f"{tmp_path}/none.npy").collect() == []
    np.save(tmp_path / "x.npy", np.arange(12.0).reshape(3, 4))
    assert [tuple(r["embedding"]) for r in datasets._read_whole_npy(spark, f"{tmp_path}/x.npy").orderBy("index").collect()] == [(0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11)]


def test_first_rows_of_documents(spark, tmp_path):
    for name, start in (("b.csv", 100), ("a.csv", 0)):
        (tmp_path / name).write_text("Title,n\n" + "".join(f'"line\nbreak {i}",{i}\n' for i in range(start, start + 40)))
    got = datasets.load_documents(spark, str(tmp_path / "*.csv"), 45)
    assert [r["n"] for r in got.collect()] == [str(i) for i in [*range(40), *range(100, 105)]] and got.columns == ["title", "n"]
