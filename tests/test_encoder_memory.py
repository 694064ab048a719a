"""An encoder's task holds few texts and vectors at a time."""

import gc

from corpusloom.sources import datasets


def test_vectors_of_few_texts_are_held(spark):
    def encoder(texts):
        held = sum(1 for x in gc.get_objects() if isinstance(x, list) and len(x) == 777 and isinstance(x[0], float))
        return [[float(held)] * 777 for _ in texts]

    rows = spark.range(0, 600, 1, 1).selectExpr("id", "if(id % 7 = 0, null, string(id)) AS text")
    got = {r["id"]: r["embedding"] for r in datasets.encode(rows, encoder, batch=4).collect()}
    assert len(got) == 600 and all((got[i] is None) == (i % 7 == 0) for i in got)
    assert max(v[0] for v in got.values() if v) <= 3 * datasets.ENCODED * 4
