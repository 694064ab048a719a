import numpy as np
import pytest

from corpusloom.llm.embeddings import cosine_links, embedding_groups, signature_plan

SCHEMA = "vec_id bigint, embedding array<float>, n_links string, rep int"


def brute(vectors, threshold=0.95):
    ids = [i for i, _ in vectors]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    links = {i: set() for i in range(len(vectors))}
    for i in range(len(vectors)):
        for j in range(len(vectors)):
            if i != j and ok[i] and ok[j] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = (np.float32(vectors[k][1]).astype(float) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
    out = {}
    for i in range(len(vectors)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(ids[j] for j in seen)
        out[ids[i]] = (len(links[i]), least, ids[i] == least)
    return out


def test_equals_brute_force_with_crowded_groups_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16))
    rows = []
    for c in range(12):
        for _ in range(int(rng.integers(1, 60))):
            rows.append((centres[c] + 0.05 * rng.standard_normal(16)).tolist())
    rows += [rows[0]] * 7 + [(3 * np.array(rows[0])).tolist(), None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [float("inf")] + [0.0] * 15, rows[1][:8]]
    order = rng.permutation(len(rows))
    vectors = [(int(k), rows[i]) for k, i in enumerate(order)]
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], "x", 1) for i, v in vectors], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(frame).collect()}
    assert got == brute(vectors)


def test_small_chunks_count_every_link_once(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    v = [(base + 0.02 * rng.standard_normal(8)).astype(np.float32).tolist() for _ in range(40)]
    frame = spark.createDataFrame([(i, 1, x) for i, x in enumerate(v)], "rep bigint, mult bigint, embedding array<float>")
    found = cosine_links(frame, 0.95, 0.999, chunk=4).groupBy("rep").sum("links").collect()
    assert {r[0]: r[1] for r in found} == {i: 39 for i in range(40)}


def test_empty_null_ids_and_plan(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = embedding_groups(spark.createDataFrame([(None, [1.0, 0.0], "x", 1), (4, [1.0, 0.0], "x", 1), (3, [2.0, 0.0], None, 1), (3, [0.0, 1.0], None, 1)], SCHEMA)).collect()
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in rows)
    assert got == [("3", 0, "3", True), ("3", 1, "3", True), ("4", 1, "3", False), ("None", 0, "None", True)]
    for n in (1, 500, 10**6):
        bits, tables = signature_plan(n)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables == pytest.approx(0.999, abs=1e-3)
