import random

import pytest

from corpusloom.llm.lines import line_dedup

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(docs, min_lines=3, min_words=50):
    """docs in order: delete every line that lies in a qualifying run that occurred before."""
    sequences = []
    for _, text in docs:
        lines = (text or "").split("\n")
        sequences.append([(p, s, len(s.split())) for p, x in enumerate(lines) if (s := x.strip(SPACE))])
    fits = lambda run: len(run) >= min_lines or sum(w for _, _, w in run) >= min_words
    first, gone = {}, [set() for _ in docs]
    for d, seq in enumerate(sequences):
        for i in range(len(seq)):
            for j in range(i + 1, min(len(seq), i + 6) + 1):
                run = seq[i:j]
                if not fits(run):
                    continue
                key = tuple(s for _, s, _ in run)
                at = first.setdefault(key, (d, i, run[-1][0]))
                if at[:2] < (d, i):
                    gone[d] |= {p for p, _, _ in run if d != at[0] or p > at[2]}
    out = []
    for (k, text), g in zip(docs, gone):
        out.append((k, None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in g), len(g)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    lines = ["a b", "c d e", "", "  ", "f", " ".join(["long"] * 55), "g h i j", " ".join(["mid"] * 30), " a b "]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 9)))) for i in range(40)]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == brute(docs)


def test_passage_at_line_boundaries_and_clean_documents(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    docs = [(1, f"intro one\n{passage}\nend"), (2, f"other start\n{passage}"), (3, "clean text\nof two lines"), (4, f"{passage} with more")]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: docs[0][1], 2: "other start", 3: docs[2][1], 4: docs[3][1]}


def test_odd_rows(spark):
    block = "x one\ny two\nz three"
    many = "\n".join(["same line"] * 5000)
    rows = [(2, block, 1), (1, block, 1), (2, block, 2), (None, block, 3), (5, None, 4), (6, "", 5), (7, many, 6), (8, block + "\n" + "w four", 7)]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")).collect() if r["text"] is not None)
    assert got == [("1", 3, 3, ""), ("2", 3, 3, ""), ("2", 3, 3, ""), ("6", 1, 0, ""), ("7", 5000, 4997, "\n".join(["same line"] * 3)), ("8", 4, 3, "w four"), ("None", 3, 0, block)]
    assert line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    null = line_dedup(spark.createDataFrame([(5, None)], "doc_id bigint, text string")).first()
    assert (null["text"], null["n_lines"], null["n_removed"]) == (None, 0, 0)
