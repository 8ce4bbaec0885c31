"""Decontamination of periodic and random texts."""

import random
import time

from test_ops import frame

from loglattice.llm import decontaminate


def test_long_periodic_text(spark):
    rows = [(1, "a b " * 50_000), (2, "x y z")]
    items = spark.createDataFrame([(7, "a b " * 800), (8, "b a " * 9)], "item_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.contamination(frame(spark, rows), items)).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (100_000, 100_000, 2, True)
    assert got[2]["n_hit"] == 0 and time.time() - start < 60


def test_random_texts_of_few_words(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    rows = [(i, text(r.randint(0, 90))) for i in range(40)] + [(None, text(40))]
    items = [(i, text(r.randint(1, 40))) for i in range(12)] + [(None, text(20)), (3, text(15))]
    for fold in (decontaminate.BROADCAST_BYTES, 0):
        decontaminate.BROADCAST_BYTES, old = fold, decontaminate.BROADCAST_BYTES
        got = decontaminate.digest(decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))).collect()
        decontaminate.BROADCAST_BYTES = old
        want = decontaminate.brute(rows, [x for x in items if x[0] is not None])
        null = decontaminate.brute(rows, items[12:13])
        for g, w, n in zip(sorted(got, key=str), sorted(want, key=str), sorted(null, key=str), strict=True):
            assert (g[0], g[1], g[3], g[4]) == (w[0], w[1], w[3], w[4]) and g[2] >= max(w[2], n[2])
