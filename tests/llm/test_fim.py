import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fim


def brute(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("spread", [1, 3, 40, 3000])
def test_lists_return_every_value(seed, spread):
    values = np.cumsum(np.random.default_rng(seed).integers(1, spread + 1, 9000)).astype(np.int64)
    low_bits, low, high, counts = fim.elias_fano(values, int(values[-1]) + 1)
    assert len(low) + len(high) < 9000 * (2 + np.log2(spread)) / 8 + 2048
    for at in [0, 1, 4095, 4096, 8999, *range(17, 9000, 613)]:
        assert fim.select(low_bits, 9000, low, high, counts, at) == values[at]


@pytest.mark.parametrize("parts", [1000, 3])
def test_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(fim, "PARTS", parts)
    monkeypatch.setattr(fim, "LEAST_HOT", 4)
    rnd = random.Random(parts)
    letters = "ab é漢🙂\x00<PSM>\n"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 60))) for _ in range(60)] + ["the same text of many rows"] * 70
    texts += ["", None, "x<P>y", "é" * 5000, "🙂" * 70_000, "a", "<S", "P>"]
    docs = [(None if i % 17 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(8, "the same text of many rows")] * 5
    got = fim.fill_in_middle(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    found = sorted(repr((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got)
    assert found == sorted(repr((i, t, *brute(i, t))) for i, t in docs)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here", "k", 2, "f")], "id string, body string, key string, part int, form string")
    got = fim.fill_in_middle(docs, id_col="id", text_col="body")
    assert got.columns == ["id", "body", "key", "part", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = got.first()
    assert (row["id"], row["body"], row["key"], row["part"], row["n"]) == ("1", "some text here", "k", 2, 14) and row["form"] == brute("1", "some text here")[1]
    assert fim.fill_in_middle(docs.limit(0), id_col="id", text_col="body").collect() == []
