import random
import re
import string
import zlib

import numpy as np
import pytest

from corpusloom.llm.fitting import sigmoid
from corpusloom.llm.quality import fit_rules, score_quality
from corpusloom.llm.text_stats import STATS, text_stats
from corpusloom.llm.toxicity import drop_toxic, fit_label_model, score_toxicity
from corpusloom.llm import queries

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("der", "len", "mas", "nor", "pel", "rin", "tor", "ves")]


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(20, 80))]
        quality, toxic = 1, 0
        if i % 6 == 0:
            quality, words = 0, [w.upper() + "!!" for w in words]
        elif i % 6 == 1:
            quality, words = 0, [w for w in words[:5] for _ in range(20)]
        if i % 5 == 0:
            toxic = 1
            for _ in range(rnd.randrange(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vexgor", "vexlum", "vexti", "blugh", "grunk"]) + rnd.choice(["", "s"]))
        rows.append((i, " ".join(words), quality, toxic))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _, _ in rows], "doc_id bigint, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, q, x, "y") for i, _, q, x in rows], "doc_id bigint, quality int, toxic int, text string")
    return docs, labels


@pytest.mark.parametrize("score,label,mod,fold,threshold", [(score_quality, 2, 5, 0, 0.3), (score_toxicity, 3, 3, 1, 0.7)])
def test_held_out_accuracy(spark, score, label, mod, fold, threshold):
    rows = corpus(900)
    got = {r["doc_id"]: r for r in score(*frames(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert {r[0] for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % mod == fold}
    right = [got[r[0]]["predicted"] == r[label] for r in held]
    assert np.mean(right) > 0.97
    for r in got.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_held_out_labels_do_not_matter(spark, score):
    rows = corpus(300)
    mod, fold = (5, 0) if score is score_quality else (3, 1)
    flip = [(i, t, 1 - q, 1 - x) if zlib.crc32(str(i).encode()) % mod == fold else (i, t, q, x) for i, t, q, x in rows]
    a, b = (sorted((r["doc_id"], r["score"]) for r in score(*frames(spark, x)).collect()) for x in (rows, flip))
    assert a == b


@pytest.mark.parametrize("score,neutral", [(score_quality, 0.5), (score_toxicity, 0.0)])
def test_odd_rows_and_no_labels(spark, score, neutral):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (None, "some words"), (5, "ok " * 100000), (5, "again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, None, None), (99, 1, 1), (1, 7, 7), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == 6 and all(r["score"] == pytest.approx(neutral, abs=1e-6) for r in got) and all(r["held_out"] for r in got if r["doc_id"] is None)
    assert score(docs.limit(0), labels).collect() == [] and score(docs, labels.limit(0)).count() == 6


def test_toxic_rows_are_dropped_by_their_text(spark):
    rows = corpus(600)
    docs, labels = frames(spark, rows)
    odd = spark.createDataFrame([(None, "vexgor blugh grunk vexlum " + rows[3][1], "x", 1.0), (None, rows[3][1], "x", 1.0), (None, None, "x", 1.0)], docs.schema)
    kept = drop_toxic(docs.union(odd), labels)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sum(r["doc_id"] is None for r in left) == 2
    toxic = {r[0] for r in rows if r[3]}
    assert sum(r["doc_id"] in toxic for r in left) <= 0.03 * len(toxic) and sum(r["doc_id"] is not None and r["doc_id"] not in toxic for r in left) >= 0.99 * (len(rows) - len(toxic))


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    model = fit_rules(x, y)
    assert 0 < len(model.rules) < 300 and np.mean((model.score(x) > 0.5) == y) > 0.97
    frame = spark.createDataFrame([tuple(float(v) for v in r) for r in x[:50]], ", ".join(f"{s} double" for s in STATS))
    assert np.allclose([r[0] for r in frame.select(model.column()).collect()], model.score(x[:50]))


def test_statistics_of_a_text():
    stats = dict(zip(STATS, text_stats([b"Aa Aa bb!\nAa Aa bb!\n\n9", None, b""])[0]))
    assert stats["log_words"] == pytest.approx(3) and stats["distinct_words"] == pytest.approx(3 / 7) and stats["distinct_lines"] == pytest.approx(2 / 3)
    assert stats["shout"] == pytest.approx(2 / 22) and stats["upper"] == pytest.approx(4 / 22) and stats["long_run"] == pytest.approx(2 / 7)
    assert not text_stats([None, b"", b" \n"]).any()


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.02) for _ in range(6)] + [rng.random(4000) < 0.3], axis=1)
    votes = np.concatenate((votes, votes[:, :1]), axis=1)  # a voter twice
    model = fit_label_model(votes, np.clip(votes[:, :6].sum(axis=1) / 2, 0.02, 0.98))
    assert abs(model.prior - y.mean()) < 0.05 and np.mean((model.posterior(votes.astype(float)) > 0.5) == y) > 0.95
    assert model.accuracy[6] < model.accuracy[1] and model.correlation[0, 7] > 0.9 and model.weight[0] < 0.6 < model.weight[1]
    assert sigmoid(np.array([0.0]))[0] == 0.5


def test_registered_names():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_label_model_follows_bayes_row_by_row():
    """Posteriors by the product rule over single votes, rates by counting, for voters that may be silent."""
    rng = np.random.default_rng(4)
    y = rng.random(500) < 0.3
    votes = np.stack([np.where(y, rng.random(500) < 0.3, rng.random(500) < 0.02) for _ in range(5)], axis=1)
    votes = np.concatenate((votes, ~votes.any(axis=1)[:, None], rng.random((500, 1)) < 0.5), axis=1)
    silent = np.arange(7) < 5
    model = fit_label_model(votes, np.clip(votes[:, :5].sum(axis=1) / 2, 0.02, 0.98), rounds=400, silent=silent, balance=0.3)
    q = model.posterior(votes.astype(float))
    for row, got in zip(votes[:60], q):
        odds = 0.3 / 0.7
        for j, vote in enumerate(row):
            if vote:
                odds *= (model.on[j] / model.off[j]) ** model.weight[j]
            elif not silent[j]:
                odds *= ((1 - model.on[j]) / (1 - model.off[j])) ** model.weight[j]
        assert got == pytest.approx(odds / (1 + odds), abs=1e-9)
    for j in range(7):
        on, off = sum(p for p, v in zip(q, votes[:, j]) if v), sum(1 - p for p, v in zip(q, votes[:, j]) if v)
        assert model.on[j] == pytest.approx((on + 0.5) / (q.sum() + 1), abs=0.01) and model.off[j] == pytest.approx((off + 0.5) / (len(q) - q.sum() + 1), abs=0.01)
    assert np.mean((q > 0.5) == y) > 0.85 and (model.weight[5:] == 1).all()  # a sixth of the first class has no vote


def test_lexicon_voters_are_families_of_words():
    from corpusloom.llm.toxicity import FeatureTable, lexicon_voters

    texts = [b"vexgor blugh plain"] * 3 + [b"vexgors grunk plain"] * 3 + [b"grunks blughs plain"] * 3 + [b"plain other words %d" % i for i in range(200)]
    y = np.array([1.0] * 9 + [0.0] * 200)
    table = FeatureTable(texts)
    voter = lexicon_voters(table, texts, y, 10)
    names = table.names(texts, np.flatnonzero(voter >= 0))
    stems = {}
    for i, name in names.items():
        stems.setdefault(int(voter[i]), set()).add(name.removeprefix(b"=")[:4])
    assert {frozenset(s) for s in stems.values()} == {frozenset({b"vexg"}), frozenset({b"blug"}), frozenset({b"grun"})}
    merged = lexicon_voters(table, texts, y, 2)
    assert set(merged[merged >= 0]) == {0, 1}


def plain_statistics(text):
    """Each statistic from its definition, one text at a time."""
    from collections import Counter

    raw = (text or "").encode()
    words, size = raw.split(), len(raw)
    if not words:
        return dict.fromkeys(STATS, 0.0)
    kinds = {"upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "digit": string.digits, "space": " \t\n\r\x0b\x0c", "mark": ".,;:'\"?()-", "shout": "!", "symbol": "#$%&*+/<=>@[\\]^_`{|}~"}
    out = {k: sum(raw.count(c.encode()) for c in v) / size for k, v in kinds.items()}
    out["other"] = max(0.0, 1 - sum(out.values()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = lambda x: max(Counter(x).values())
    out |= {"log_words": np.log2(1 + len(words)), "mean_word": (size - len(words)) / len(words), "longest_word": max(map(len, words)), "distinct_words": len(set(words)) / len(words), "top_word": most(words) / len(words)}
    out |= {"long_run": sum(a == b for a, b in zip(words, words[1:])) / len(words), "log_lines": np.log2(1 + len(lines)), "mean_line": len(words) / len(lines), "distinct_lines": len(set(lines)) / len(lines), "top_line": most(lines) / len(lines)}
    return out | {"sentences": sum(raw.count(c) for c in (b".", b"!", b"?")) / len(words)}


def test_quality_scores_equal_rules_read_one_by_one(spark, monkeypatch):
    """Every document's statistics from their definitions, every rule tested by itself."""
    from corpusloom.llm import quality

    fitted = []
    monkeypatch.setattr(quality, "fit_rules", lambda *a, **k: fitted.append(fit_rules(*a, **k)) or fitted[-1])
    rows = corpus(400) + [(1000, None, 1, 0), (1001, "", 0, 0), (1002, "Ä b\n\nc? [d] \"e\"\\\\f-", 1, 0), (1003, "word " * 20000, 0, 0)]
    got = {r["doc_id"]: r["score"] for r in score_quality(*frames(spark, rows)).collect()}
    model = fitted[0]
    assert model.rules and len(got) == len(rows)
    for i, text, _, _ in rows:
        stats = dict(zip(STATS, text_stats([None if text is None else text.encode()])[0]))
        assert stats == pytest.approx(plain_statistics(text), abs=1e-9)
        z = model.intercept
        for rule, w in zip(model.rules, model.weights):
            z += w * all((stats[STATS[f]] > t) if above else (stats[STATS[f]] <= t) for f, t, above in rule)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_scores_equal_weights_added_word_by_word(spark):
    from corpusloom.llm.toxicity import PATTERNS, learn_toxicity

    rows = corpus(500) + [(1000, None, 1, 0), (1001, "", 1, 0), (1002, "VEXGOR! vexgor, (Blugh) you ****", 1, 0), (1003, "plain " * 30000 + "vexgor blugh", 1, 0)]
    docs, labels = frames(spark, rows)
    model = learn_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels).collect()}
    assert model.weights and len(got) == len(rows)
    for i, text, _, _ in rows:
        z = model.intercept
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()))
        features = {b"=" + w for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) >= n}
        z += sum(w for f, w in model.weights.items() if f in features)
        if text:
            z += sum(w for w, p in zip(model.patterns, PATTERNS.values()) if p.search(text.encode()))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


@pytest.mark.parametrize("n", [2, 4, 10, 20, 30])
@pytest.mark.parametrize("id_col", ["doc_id", "id"])
def test_quality_from_few_labels(spark, n, id_col):
    docs = spark.createDataFrame([(i, "some words here" if i % 2 else "x") for i in range(3 * n)], f"{id_col} bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], f"{id_col} bigint, quality int")
    got = score_quality(docs, labels, id_col=id_col, trees=3).collect()
    assert len(got) == 3 * n and all(0 < r["score"] < 1 for r in got)
