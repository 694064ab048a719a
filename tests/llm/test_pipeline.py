"""The pipeline on a small table against a plain version of every stage, each judged on its own input."""

import hashlib
import random

import pytest

import corpus_pipeline
from corpusloom.llm.queries import DOMAINS, LANGUAGES
from corpusloom.llm.toxicity import learn_toxicity, score_toxicity
from tests.llm.test_classifiers import corpus as labelled_corpus
from tests.llm.test_decontaminate import distance
from tests.llm.test_hilbert import placed_by_hand
from tests.llm.test_mixing import waterfill
from tests.llm.test_near_copies import similar

#: Names that the engine uses inside, as columns of the input.
SCHEMA = "doc_id bigint, text string, lang string, source string, rank int, __n string, hilbert string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    vocabulary = [f"word{i}" for i in range(900)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.choice([6, 12, 25])))) for i in range(6)] + [(6, None), (7, "too short"), (8, "")]
    rows = []

    def add(words, doc_id="next"):
        rows.append((len(rows) if doc_id == "next" else doc_id, None if words is None else " ".join(words), rnd.choice(["en", "en", "de", "fr", "it", None]), rnd.choice(["src0", "src0", "src1", "src5", "odd", None]), len(rows), "x", "y"))

    for _ in range(60):
        add(prose(rnd.randrange(8, 90)))
    for _ in range(12):
        base = prose(rnd.randrange(30, 80))
        add(base)
        for edits in rnd.sample([0, 1, 2, 9], 2):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), edits):
                copy[at] = rnd.choice(vocabulary)
            add(copy)
    for i, text in items[:6]:
        own = text.split()
        own[0] = "changed" if i % 2 else own[0]
        add(prose(20) + own + prose(20))
    for insults in (["vexgor", "blugh", "grunk", "vexlum"], ["vextis", "blughs", "grunks", "vexgor"]):
        add(prose(30) + insults + prose(5))
    for words in (None, [], [" ", "\n"], prose(4000), ["short"]):
        add(words)
    again = rows[3]
    rows.append(again)
    rows.append((None, *again[1:]))
    rows.append((None, " ".join(prose(25)), *again[2:]))
    rows.append((again[0], " ".join(prose(25)), *again[2:]))
    training = labelled_corpus(600)
    path = tmp_path_factory.mktemp("tables")
    # the labelled rows are documents as well
    rows += [(10_000 + i, t, "en", "src2", i, "x", "y") for i, t, _, _ in training]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10_000 + i, q, x) for i, _, q, x in training], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def first_of_each_group(rows):
    """All pairs compared; of each component the row of the least id, nulls last."""
    texts = sorted({r[1] or "" for r in rows})
    rep = {t: t for t in texts}

    def find(t):
        while rep[t] != t:
            t = rep[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if (not a.split() and not b.split()) or similar(a, b):
                rep[find(a)] = find(b)
    groups = {}
    for r in rows:
        groups.setdefault(find(r[1] or ""), []).append(r)
    return groups


def mixed_by_hand(rows):
    """Budgets by filling level after level, prefixes by sorting; ``{(doc_id, text): tokens taken}``."""
    size = lambda r: len((r[1] or "").split())
    leaves = {}
    for r in rows:
        digits = "".join(c for c in (r[3] or "") if c.isdigit())
        if size(r):
            leaves.setdefault((list(DOMAINS)[int(digits or 0) % 4], r[2] or "unknown", r[3] or "unknown"), []).append(r)
    capacity = lambda key: sum(size(r) for k, own in leaves.items() if k[: len(key)] == key for r in own)
    budget = {(): int(sum(map(size, rows)) * corpus_pipeline.MIXTURE_SHARE)}
    for depth in range(3):
        for parent in [k for k in budget if len(k) == depth]:
            below = {k[: depth + 1] for k in leaves if k[:depth] == parent}
            weight = lambda k: DOMAINS[k[0]] if depth == 0 else LANGUAGES.get(k[1], corpus_pipeline.OTHER_LANGUAGES) if depth == 1 else 1.0
            budget |= waterfill({k: (weight(k), capacity(k)) for k in below}, budget[parent])
    taken = {}
    for key, own in leaves.items():
        passes, rest = divmod(budget[key], sum(map(size, own)))
        order = lambda r: (int(hashlib.md5(f"7-{passes}-{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, size(r))
        for r in sorted(own, key=order):
            part = size(r) if passes else min(rest, size(r))
            if part > 0:
                taken[r[0], r[1]] = part
            rest -= 0 if passes else part
    return taken


def test_every_stage_equals_its_plain_version(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows, stages = [tuple(r) for r in docs.collect()], dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]

    def through(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, SCHEMA), path)
        assert name == "sharding" or out.schema.simpleString() == docs.schema.simpleString()
        return [tuple(r) for r in out.collect()]

    by_row = lambda found: sorted(found, key=repr)
    # toxicity: the model's weights added up for each text
    model = learn_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = [model.scores([None if r[1] is None else r[1].encode()])[0] for r in rows]
    clean = through("toxicity", rows)
    assert by_row(clean) == by_row(r for r, s in zip(rows, scores) if s < 0.7) and 30 < len(rows) - len(clean) < 200
    assert score_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 0").count() == len(clean)
    assert not any("vexgor" in (r[1] or "").split() and r[0] is not None and r[0] < 10_000 for r in clean)
    # near copies: all pairs
    groups, distinct = first_of_each_group(clean), through("simhash", clean)
    least = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()]
    assert sorted((r[0] is None, r[0] or 0) for r in distinct) == sorted((r[0] is None, r[0] or 0) for r in least) and len(clean) - len(distinct) >= 10
    assert set(distinct) <= set(clean)
    # benchmark: every document against every item
    patterns = [t.split() for _, t in items if t and len(t.split()) >= 5]
    leaks = [r for r in distinct if any(distance(p, (r[1] or "").split()) <= int(len(p) * 0.2 + 1e-9) for p in patterns)]
    unseen = through("decontamination", distinct)
    assert len(leaks) >= 6 and by_row(unseen) == by_row(r for r in distinct if r not in leaks)
    # mixture
    mixture, taken = through("mixing", unseen), mixed_by_hand(unseen)
    known = {(r[0], r[1]): r for r in unseen}
    left = dict(taken)
    for r in mixture:
        own = next(k for k in left if k[0] == r[0] and k[1].startswith(r[1]) and known[k][2:] == r[2:])
        assert len(r[1].split()) == left.pop(own)
    assert not left and 0.7 < len(mixture) / len(unseen) < 1
    # shards
    named = [r for r in mixture if r[0] is not None and sum(o[0] == r[0] for o in mixture) == 1]
    placed = stages["sharding"](spark, spark.createDataFrame(named, SCHEMA), path)
    assert placed.columns[:6] == ["doc_id", "text", "lang", "source", "rank", "__n"]
    expected = placed_by_hand({r[0]: (r[3], r[2], len(r[1].encode())) for r in named})
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in placed.collect()} == expected


def test_the_whole_run_is_its_stages_in_a_row(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, SCHEMA), path)
        rows = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*out.columns).collect()) and len(rows) > 100


@pytest.mark.parametrize("stage", [s[1] for s in corpus_pipeline.STAGES[:-1]])
def test_stages_on_empty_tables(spark, folder, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder[0]).collect() == []
