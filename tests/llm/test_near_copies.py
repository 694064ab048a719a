import random

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm.near_copies import near_copy_dedup, near_copy_groups, shared_counts

SCHEMA = "doc_id bigint, text string, node string, t string"


def similar(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])


def kept_by_definition(rows):
    """Ids of the first row of each component of all pairs."""
    rep = list(range(len(rows)))

    def find(x):
        while rep[x] != x:
            x = rep[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if similar(a, b):
                x, y = find(i), find(j)
                rep[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def corpus():
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = []
    for size in (6, 30, 100, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 2, 4, 8, 20):
                copy = list(base)
                for at in rnd.sample(range(size), min(edits, size)):
                    copy[at] = word()
                rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile", [200_000, 300])
def test_rows_kept_equal_all_pairs_compared(spark, tile):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = near_copy_dedup(docs, tile=tile)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == kept_by_definition(rows)


def test_the_pipeline_drops_copies_with_a_few_edits(spark):
    words = [f"v{i}" for i in range(200)]
    edited = [w if i not in (40, 90, 150) else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "another text of some words altogether")], "doc_id bigint, text string")
    stage = corpus_pipeline.STAGES[1][1]
    assert similar(" ".join(words), " ".join(edited)) and sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [1, 3]


def test_repeated_and_null_ids_blank_texts_and_empty_tables(spark):
    rows = [(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (1, "delta epsilon zeta"), (2, "Delta epsilon\tzeta"), (None, "alpha beta gamma"), (None, "one more text"), (None, "one more text"), (5, None), (4, " ")]
    got = near_copy_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got) == [(False, 1, "alpha beta gamma"), (False, 1, "delta epsilon zeta"), (False, 4, " "), (True, 0, "one more text")]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copy_dedup(empty).collect() == [] and near_copy_groups(empty).collect() == []


def test_shared_counts_over_many_columns():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (1, 50, 2000, 2500)]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets])
    assert shared_counts(flat, owner, 4, flat, owner, 4).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
