import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm.simhash import fingerprint, fingerprint_links, simhash_dedup, simhash_fingerprints, simhash_groups

SCHEMA = "doc_id bigint, text string, fp string, component_id string"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \t\n", "one", "One two", "ÀB c d", "a\x85b c d", "x y z x y z x", "word " * 5000])
def test_fingerprint_equals_the_definition(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def brute_components(prints, radius=2):
    rep = {i: i for i, _ in prints}

    def find(x):
        while rep[x] != x:
            x = rep[x]
        return x

    for a, x in prints:
        for b, y in prints:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= radius:
                ra, rb = find(a), find(b)
                rep[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in rep}


def test_links_equal_brute_force_over_all_pairs(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    values = sorted({x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for x in base for _ in range(6)})
    prints = list(enumerate(np.array(values, np.uint64).view(np.int64).tolist()))
    expected = brute_components(prints)
    distinct = spark.createDataFrame([(fp, i) for i, fp in prints], "fp bigint, rep bigint")
    for segments, chunk in ((4, 512), (4, 2), (8, 16)):
        rep = {i: i for i, _ in prints}

        def find(x):
            while rep[x] != x:
                x = rep[x]
            return x

        for r in fingerprint_links(distinct, 2, segments, chunk).collect():
            a, b = find(r["src"]), find(r["dst"])
            rep[max(a, b)] = min(a, b)
        assert {i: find(i) for i in rep} == expected


def test_groups_on_nulls_copies_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, "a b c d e", "x", "y"), (2, "A B c D e", "x", "y"), (7, None, "x", "y"), (3, "", "x", "y"), (9, long, "x", "y"), (1, long + " tail", "x", "y"), (4, "a b c d e", "x", "y"), (4, "a b c d e", "x", "y"), (None, "a b c d e", "x", "y"), (11, "quite another text here", None, None)]
    got = simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by == {5: 2, 2: 2, 4: 2, 7: 3, 3: 3, 9: 1, 1: 1, None: None, 11: 11}
    kept = simhash_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 11, None]


def test_rows_of_one_id_link_through_it(spark):
    rows = [(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (2, "delta epsilon zeta")]
    assert {(r["doc_id"], r["component_id"]) for r in simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {(1, 1), (2, 1)}


def test_unrelated_texts_of_one_id_stay(spark):
    rows = [(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (2, "delta epsilon zeta"), (3, "alpha beta gamma")]
    kept = simhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in kept) == [(1, "alpha beta gamma"), (1, "delta epsilon zeta")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_groups(empty).collect() == [] and simhash_fingerprints(empty).collect() == [] and simhash_dedup(empty).collect() == []


def test_a_crowded_tile_is_many_tasks_work(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm.simhash import dealt_pairs, half_offsets, packed_tiles

    # all in one tile: 16 of 64 bits, four in each segment
    rnd = random.Random(2)
    values = {sum(1 << 16 * s + b for s in range(4) for b in rnd.sample(range(16), 4)) for _ in range(3000)}
    keyed = spark.createDataFrame([(7, np.uint64(v).astype(np.int64).item(), i) for i, v in enumerate(sorted(values))], "key bigint, fp bigint, rep bigint")
    tiles = packed_tiles(keyed, 64, True)
    n = tiles.count()
    pairs = dealt_pairs(tiles, half_offsets(4, 2, 21), True).withColumn("task", F.spark_partition_id())
    work = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert sum(work) == n * (n + 1) // 2 and len(work) >= 12 and max(work) < sum(work) / 4


@pytest.mark.parametrize("chunk", [512, 7])
def test_wide_links_equal_brute_force(spark, chunk):
    from corpusloom.llm import simhash

    rng = np.random.default_rng(chunk)
    rows, sets = [], []
    for base in range(25):
        size = int(rng.integers(4, 300))
        own = rng.integers(0, 1 << 63, size, np.uint64)
        for _ in range(5):
            copy = own.copy()
            copy[rng.random(size) < rng.choice([0.0, 0.03, 0.08, 0.3])] = rng.integers(0, 1 << 63, 1, np.uint64)
            sets.append(np.unique(copy))
    prints = [simhash.wide_fingerprint(s) for s in sets]
    rows = [(p.view(np.int64).tolist(), len(s), i) for i, (p, s) in enumerate(zip(prints, sets))]
    rep = list(range(len(rows)))

    def find(rep, x):
        while rep[x] != x:
            x = rep[x]
        return x

    def join(rep, a, b):
        a, b = find(rep, a), find(rep, b)
        rep[max(a, b)] = min(a, b)

    near = []
    for i in range(len(rows)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                near.append((i, j))
                assert np.bitwise_count(prints[i] ^ prints[j]).sum() <= simhash.wide_radius(0.8)
    got = list(rep)
    for r in simhash.wide_links(spark.createDataFrame(rows, "fp array<bigint>, n bigint, rep bigint"), 0.8, chunk=chunk).collect():
        join(got, r["src"], r["dst"])
        assert np.bitwise_count(prints[r["src"]] ^ prints[r["dst"]]).sum() < 128
    assert len(near) > 50 and all(find(got, i) == find(got, j) for i, j in near)


def test_few_chunks_are_shuffled_for_a_pair(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm import simhash
    from corpusloom.llm.simhash import dealt_pairs

    tiles = spark.range(256).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("chunk"), F.struct(F.array("id").alias("fps"), F.array("id").alias("reps")).alias("x"))
    pairs = dealt_pairs(tiles, [0], True)
    got = {(r["a"]["reps"][0], r["b"]["reps"][0], r["same"]) for r in pairs.collect()}
    assert got == {(a, b, a == b) for a in range(256) for b in range(a, 256)} and pairs.count() == len(got)
    sent = sum(side.count() for side in simhash.grid_sides(tiles, [0], True))
    assert sent < 0.1 * len(got)
    cells = dealt_pairs(tiles, [0], True).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in cells) < len(got) / 2
