import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=3, top=200):
    groups, seen = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or ""][source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in seen[lang].items() if n >= min_docs), key=lambda t: t.encode())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if sources[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def audit(spark, rows, **more):
    got = divergence.divergence_audit(spark.createDataFrame(rows, "text string, lang string, source string, lang_ int").drop("lang_"), **more)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("cells, top", [(1 << 15, 200), (8, 3)])
def test_equals_brute_force(spark, monkeypatch, cells, top):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rnd = random.Random(cells)
    words = ["Alpha", "beta", "ß", "漢字", "é", "zeta9x", "a", "b", "c", "ÄB", "", "🙂", "don't"]
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words[: 5 + i % 9]) for _ in range(rnd.randrange(0, 30)))
        rows.append((None if i % 31 == 0 else text, [None, "en", "de", ""][i % 4], [None, "s1", "s2", "s3", "", "S4"][rnd.randrange(6)]))
    rows += [("one two", "fr", "s1"), ("", "fr", "s2"), (None, "fr", None), ("x " * 3000, "it", "only")]
    assert audit(spark, [(*r, 0) for r in rows], top=top) == brute(rows, top=top)


def test_empty_table_and_long_terms(spark, monkeypatch):
    assert audit(spark, []) == []
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "COUNTED", 3)
    rows = [("averyverylongterm and short ones", "en", f"s{i % 2}") for i in range(4)] + [("tail" * 9, "en", "s1")] * 3
    assert audit(spark, [(*r, 0) for r in rows]) == brute(rows)


def test_shares_are_exact():
    counts, total = np.array([0, 1, 10**14, 3 * 10**15]), 4 * 10**15 + 7
    assert divergence.shares(counts, total, 12345).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 12345) for c in counts]
