import hashlib
import random

from pyspark.sql import functions as F

from corpusloom.llm.mixing import count_tokens, cut_tokens, mix, share_budget, take_mixture


def waterfill(children, budget):
    """children: name -> (weight, capacity); whole tokens by level, what rounding leaves to the first with room."""
    live = {k: (w, c) for k, (w, c) in children.items() if w > 0}
    budget = min(budget, sum(c for _, c in live.values()))
    full, open_ = {}, dict(live)
    while open_:
        level = (budget - sum(full.values())) / sum(w for w, _ in open_.values())
        tight = {k: c for k, (w, c) in open_.items() if c / w < level}
        if not tight:
            break
        full |= tight
        open_ = {k: v for k, v in open_.items() if k not in tight}
    level = (budget - sum(full.values())) / sum(w for w, _ in open_.values()) if open_ else 0
    share = {k: full.get(k, int(level * w + 1e-6)) for k, (w, _) in live.items()}
    rest = budget - sum(share.values())
    for k in sorted(live):
        more = min(rest, live[k][1] - share[k])
        share[k] += more
        rest -= more
    return {k: share.get(k, 0) for k in children}


def test_shares_equal_waterfilling(spark):
    rnd = random.Random(2)
    for budget in (0, 7, 100, 1000, 10**6):
        children = {f"c{i}": (rnd.choice([0.0, 0.5, 1.0, 3.0]), rnd.randrange(0, 400)) for i in range(9)}
        rows = [(k, w, c, budget) for k, (w, c) in children.items()]
        got = share_budget(spark.createDataFrame(rows, "c string, weight double, capacity bigint, budget bigint"), [], "c")
        assert {r["c"]: r["share"] for r in got.collect()} == waterfill(children, budget)


def tree():
    return {"lang": F.col("lang"), "source": F.col("source")}, [F.when(F.col("lang") == "en", 3.0).when(F.col("lang") == "de", 1.0), F.lit(1.0)]


def corpus():
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 30)), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 7}", "x") for i in range(400)]
    return rows + [(400, None, "en", "hot", "x"), (401, "a b", None, None, "x")]


def test_budgets_prefixes_and_epochs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens string")
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total = sum(size.values())
    for fraction, epochs in ((0.3, 1), (1.5, 3)):
        got = mix(docs, *tree(), fraction, epochs, range_rows=8).collect()
        leaves, by_lang = {}, {}
        for i, t, lang, source, _ in rows:
            if size[i]:
                leaves.setdefault((lang or "unknown", source or "unknown"), []).append(i)
        caps = lambda key: sum(size[i] for k, ids in leaves.items() if k[: len(key)] == key for i in ids) * epochs
        langs = waterfill({k: ({"en": 3.0, "de": 1.0}.get(k, 0.0), caps((k,))) for k in {k[0] for k in leaves}}, int(total * fraction))
        expected = {}
        for lang, amount in langs.items():
            shares = waterfill({k[1]: (1.0, caps(k)) for k in leaves if k[0] == lang}, amount)
            for source, budget in shares.items():
                ids = leaves[lang, source]
                passes, rest = divmod(budget, sum(size[i] for i in ids))
                for e in range(passes):
                    expected |= {(i, e): size[i] for i in ids}
                for i in sorted(ids, key=lambda i: (int(hashlib.md5(f"7-{passes}-{i}".encode()).hexdigest()[:15], 16), i)):
                    if rest > 0:
                        expected[i, passes] = min(rest, size[i])
                        rest -= size[i]
        assert {(r["doc_id"], r["epoch"]): r["tokens_taken"] for r in got} == expected


def test_taken_documents_have_their_columns_and_cut_texts(spark):
    docs = spark.createDataFrame([(1, " a  b\nc d", "en", "s", 5), (1, " a  b\nc d", "en", "s", 5), (None, "e f g", "en", "s", 6), (3, "x", "fr", "s", 7)], "doc_id bigint, text string, lang string, source string, epoch int")
    mixture = mix(docs, *tree(), 0.5, 1)
    taken = take_mixture(docs, mixture)
    assert taken.columns == docs.columns
    assert sum(len(r["text"].split()) for r in taken.collect()) == sum(r["tokens_taken"] for r in mixture.collect()) == 6
    assert mix(docs.limit(0), *tree(), 0.5).collect() == [] and take_mixture(docs.limit(0), mixture).collect() == []


def test_tokens(spark):
    row = spark.range(1).select(count_tokens(F.lit(None).cast("string")), count_tokens(F.lit(" a\u00a0b\tc ")), cut_tokens(F.lit(" a  b\nc d"), F.lit(3)), cut_tokens(F.lit("a b"), F.lit(0))).first()
    assert tuple(row) == (0, 2, " a  b\nc", "")


def test_the_pipeline_takes_unlisted_languages(spark):
    import corpus_pipeline

    rows = [(i, "one two three four five", ("en", "it", None)[i % 3], "s0") for i in range(60)]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), "").collect()
    assert {r["lang"] for r in got} == {"en", "it", None} and len(got) == 48


def test_taken_documents_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "__id", "__th", "__take", "__one", "__h", "id", "hash", "takes", "own", "row"]
    docs = spark.createDataFrame([(i, "a b c d", *"0123456789") for i in range(4)] + [(None, "w x", *"9876543210"), (7, None, *"9876543210")], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    mixture = mix(docs, {"lang": F.lit("en")}, [F.lit(1.0)], 1.0)
    got = take_mixture(docs, mixture)
    assert got.columns == names and sorted(str(r["doc_id"]) for r in got.collect()) == ["0", "1", "2", "3", "None"]
    assert take_mixture(docs, mixture.limit(0)).collect() == [] and take_mixture(docs.limit(0), mixture).collect() == []
