import random

import pytest

from corpusloom.llm.decontaminate import FOUND_BY_ONE, RECALL, REPETITIONS, SAMPLED, SEED, ItemIndex, benchmark_hits, best_match, decontaminate, found_share, repetitions_for, words_of


def distance(pattern, text):
    """Least edit distance of the pattern to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edited(words, n, rnd):
    words = list(words)
    for _ in range(n):
        i = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            words[i] = f"new{rnd.randrange(99)}"
        elif kind == 1:
            words.insert(i, f"ins{rnd.randrange(99)}")
        else:
            del words[i]
    return words


def test_bit_vector_search_equals_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, n))] for n in (9, 14))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert best_match(masks, len(a), b)[0] == distance(a, b)


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_recall_at_edits_and_no_false_hits(share, least):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(10, 50)))) for i in range(60)]
    docs, wanted = [], set()
    for i, text in items:
        words = text.split()
        body = edited(words, int(len(words) * share), rnd)
        docs.append(" ".join([rnd.choice(vocabulary) for _ in range(40)] + body + [rnd.choice(vocabulary) for _ in range(40)]))
        wanted.add((i, i))
    docs += [" ".join(rnd.choice(vocabulary) for _ in range(200)) for _ in range(30)] + ["w1 " * 300]
    index = ItemIndex([(i, t.encode()) for i, t in items], 0.8, 5, 32, 2, 29)
    got = {(r, j): d for r, j, d, _ in index.matches([d.encode() for d in docs])}
    assert len(wanted & set(got)) >= least * len(wanted)
    for (r, j), d in got.items():
        pattern = words_of(items[j][1].encode())
        assert distance(pattern, words_of(docs[r].encode())) <= d <= int(len(pattern) * 0.2 + 1e-9)


def test_hits_and_filter_on_edge_cases(spark):
    item = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    long = "filler " * 20000 + item + " more " * 100
    docs = spark.createDataFrame([(1, long, "a"), (2, None, "b"), (3, "", "c"), (4, item.upper() + "!", "d"), (4, item, "e"), (None, item, "f"), (6, item[:30], "g"), (7, "Too short", "h")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "too short", 0), (4, item, 0), (5, "", 0)], "item_id bigint, text string, distance int")
    got = sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in benchmark_hits(docs, bench).collect())
    assert got == sorted((d, i, 0) for d in ("1", "4", "4", "None") for i in (1, 4))
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == ["b", "c", "g", "h"]
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in benchmark_hits(docs, bench, block_items=1).collect()) == sorted((d, i) for d in ("1", "4", "4", "None") for i in (1, 4))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert benchmark_hits(docs, bench).collect() == [] and benchmark_hits(one, bench).collect() == [] and decontaminate(one, bench).count() == 1


def test_hits_equal_all_pairs_compared(spark):
    """Every document against every item by dynamic programming over all runs of words."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 6, 9, 14, 20, 31])))) for i in range(20)] + [(20, "")]
    docs = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            own = items[rnd.randrange(20)][1].split()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = edited(own, rnd.randrange(len(own) // 4 + 1), rnd)
        docs.append((i, " ".join(words)))
    expected = {}
    for d, text in docs:
        for k, item in items:
            pattern, allowed = item.split(), int(len(item.split()) * 0.2 + 1e-9)
            if len(pattern) >= 5 and (least := distance(pattern, text.split())) <= allowed:
                expected[d, k] = least
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in benchmark_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(expected) > 30 and got == expected
    kept = decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_repetitions_reach_the_recall_that_they_are_made_for():
    assert REPETITIONS == repetitions_for(RECALL) == 32 and repetitions_for(0.5) == 2
    rnd = random.Random(3)
    items = [" ".join(f"v{rnd.randrange(3000)}" for _ in range(rnd.choice([20, 30, 40]))) for _ in range(300)]
    docs = [" ".join([f"x{rnd.randrange(3000)}" for _ in range(30)] + edited(t.split(), len(t.split()) // 5, rnd) + ["end"] * 5) for t in items]
    for repetitions in (2, 6):
        index = ItemIndex(list(enumerate(t.encode() for t in items)), 0.8, 5, repetitions, SAMPLED, SEED)
        found = {r for r, j, _, _ in index.matches([d.encode() for d in docs]) if r == j}
        assert len(found) / len(docs) >= 1 - (1 - FOUND_BY_ONE) ** repetitions - 0.08


@pytest.mark.parametrize("similarity, sampled", [(0.8, 4), (0.7, 2), (0.9, 5), (0.6, 2)])
def test_repetitions_follow_from_similarity_and_sampled_steps(similarity, sampled):
    rnd = random.Random(sampled)
    items = [" ".join(f"v{rnd.randrange(700)}" for _ in range(rnd.choice([20, 30]))) for _ in range(60)]
    docs = [" ".join([f"x{rnd.randrange(700)}" for _ in range(30)] + edited(t.split(), int(len(t.split()) * (1 - similarity) + 1e-9), rnd) + ["end"] * 5) for t in items]
    index = ItemIndex(list(enumerate(t.encode() for t in items)), similarity, 5, repetitions_for(0.9999, found_share(similarity, sampled)), sampled, SEED)
    found = {r for r, j, _, _ in index.matches([d.encode() for d in docs]) if r == j}
    assert len(found) >= 59


def test_an_id_named_as_a_result_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")
    with pytest.raises(ValueError):
        benchmark_hits(docs, docs, id_col="item_id")
