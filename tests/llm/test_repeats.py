import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import repeats, suffix_arrays


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append(([tuple(map(int, x)) for x in edges.reshape(-1, 2)], bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(spark, texts, length):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length).orderBy("doc_id").collect()
    want = brute(texts, length)
    for r, t, (spans, kept) in zip(got, texts, want, strict=True):
        assert r["text"] == t and r["n_bytes"] == len((t or "").encode())
        assert [(s["start"], s["stop"]) for s in r["removed"]] == spans and bytes(r["kept"]) == kept, t


def near_copies(rnd, n, words, edits):
    base = [f"{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rnd.randrange(words)] = f"e{rnd.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("whole", [64, 0, 10**9])
def test_suffix_arrays_and_common_prefixes(monkeypatch, whole):
    monkeypatch.setattr(suffix_arrays, "WHOLE_BUCKETS", whole)
    for seed in range(150):
        rnd = random.Random(seed)
        k = rnd.choice([1, 2, 3, 26, 256])
        text = bytes(rnd.randrange(k) for _ in range(rnd.randrange(0, 60))) * rnd.choice([1, 1, 3])
        want = sorted(range(len(text)), key=lambda i: text[i:])
        letters = np.frombuffer(text, np.uint8)
        got = suffix_arrays.suffix_array(letters)
        assert got.tolist() == want
        shared = [0] * len(text)
        for a, b in zip(want, want[1:]):
            while max(a, b) + shared[b] < len(text) and text[a + shared[b]] == text[b + shared[b]]:
                shared[b] += 1
        assert suffix_arrays.permuted_common_prefixes(letters, got).tolist() == shared


@pytest.mark.parametrize("length", [5, 40, 200])
def test_every_string_has_one_anchor_that_it_alone_decides(length):
    rnd = random.Random(length)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 900))) for _ in range(12)] + [b"", b"x" * 700]
    text, at, first, last, key = repeats.anchors(texts, length)
    owned, kinds = [], {}
    for t, a, i, j, h in zip(*(x.tolist() for x in (text, at, first, last, key))):
        for w in range(i, j + 1):
            owned.append((t, w))
            assert w <= a and a + repeats.gram_length(length) <= w + length
            assert kinds.setdefault(texts[t][w : w + length], (h, a - w)) == (h, a - w)
    assert sorted(owned) == [(t, w) for t, x in enumerate(texts) for w in range(len(x) - length + 1)]


@pytest.mark.parametrize("crowded, piece, shard", [(2048, 1 << 18, 1 << 20), (3, 300, 2000)])
def test_equals_brute_force(spark, monkeypatch, crowded, piece, shard):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "SHARD", shard)
    rnd = random.Random(crowded)
    passage = " ".join(f"p{rnd.randrange(999)}" for _ in range(60))
    line = "a licence line that stands in many documents, of more than a hundred and sixteen bytes, but with other words around it every time"
    texts = near_copies(rnd, 12, 120, 3) + [f"{rnd.random()} {passage} {rnd.random()}" for _ in range(6)] + [f"{rnd.random()} " * 9 + line + f" {rnd.random()}" * 9 for _ in range(12)]
    texts += ["same text " * 30, "same text " * 30, "ab" * 400, "ab" * 100, "ab" * 99 + "a", "x" * 199, "x" * 200, "y" * 201, "z" * 900, "é漢" * 60 + "🙂" * 60, "🙂" * 49, "", None, None, "clean " + str(rnd.random())]
    check(spark, texts, 200)


@pytest.mark.parametrize("seed", range(2))
def test_short_strings_over_few_letters(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "CROWDED", 2)
    monkeypatch.setattr(repeats, "SHARD", 500)
    rnd = random.Random(seed)
    check(spark, ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60))) for _ in range(25)], 7)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", "r" * 300, 1), ("k", "r" * 300, None), (None, None, 2)], "key string, body string, row int")
    got = repeats.remove_repeats(docs, text_col="body")
    assert got.columns == ["key", "body", "row", "n_bytes", "removed", "kept"]
    assert sorted((r["n_bytes"], bytes(r["kept"])) for r in got.collect()) == [(0, b""), (300, b""), (300, b"")]
    assert repeats.remove_repeats(docs.limit(0), text_col="body").collect() == []
