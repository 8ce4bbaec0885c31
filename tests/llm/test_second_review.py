"""What the findings of the second review asked for: colliding hashes, repeated rows in samples, tables that are left behind, plain twins."""

import os
import random

import numpy as np
import pytest
from test_ops import corpus, frame

from loglattice.llm import linetree, nbsvm, queries, secrets
from loglattice.llm.common import identified, scope, stash


def test_line_dedup_doesnt_rest_on_one_hash(spark, monkeypatch):
    """With the first hash cut to 3 bits nearly all lines collide in it; the second tells them apart."""
    monkeypatch.setattr(linetree, "FIRST_BITS", 3)
    r = random.Random(8)
    shared = [" ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(1, 9))) for _ in range(30)]
    rows = [(d, "\n".join(r.choice(shared) if r.random() < 0.3 else " ".join(r.choice("abcdefghijkl") * 3 + str(r.choice("xyz")) for _ in range(6)) for _ in range(8))) for d in range(60)]
    got = linetree.drop_recurring(frame(spark, rows)).select("row.doc_id", "n_lines", "n_dropped", "row.text").collect()
    assert sorted(map(tuple, got)) == sorted(linetree.brute(rows))


def test_samples_hold_repeated_rows_once(spark):
    rows = [(1, "the same text again")] * 300 + [(k, f"text {k} of its own") for k in range(2, 40)]
    docs = identified(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)] * 5, "doc_id long, quality int, toxic int")
    seen = []
    original = nbsvm.fit
    try:
        nbsvm.fit = lambda x, y: (seen.append(len(x)), original(x, y))[1]
        nbsvm.train(docs, marks)
        nbsvm.train(docs, marks, sample=7)
    finally:
        nbsvm.fit = original
    assert seen[0] <= 39 and seen[1] == 7
    held = []
    fit = secrets.fit
    try:
        secrets.fit = lambda chains: (held.append(len(chains)), fit(chains, 1))[1]
        secrets.train(identified(spark.createDataFrame([(1, "api_key = abcdef0123456789abcd")] * 400 + [(2, "plain words")], "doc_id long, text string")))
    finally:
        secrets.fit = fit
    assert held == [2]


def test_support_vectors_equal_plain_loops():
    """Ratios, dual steps and scores, feature by feature."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, int(rng.integers(1, 9)))).astype(np.int32) for _ in range(40)]
    labels = np.array([float(3 in r.tolist() or rng.random() < 0.3) for r in rows])
    weights, bias, slope, shift, ratio = nbsvm.fit(rows, labels, epochs=3)
    n, ones = len(rows), int(sum(labels))
    count = [{f: nbsvm.ALPHA + sum(1 for r, y in zip(rows, labels, strict=True) if y == c and f in r.tolist()) for f in range(30)} for c in (0, 1)]
    mass = [sum(c.values()) + nbsvm.ALPHA * (nbsvm.DIMS - 30) for c in count]
    r = {f: np.log(count[1][f] / mass[1]) - np.log(count[0][f] / mass[0]) for f in range(30)}
    assert all(ratio[f] == pytest.approx(r[f]) for f in range(30))
    w, b, dual = dict.fromkeys(range(30), 0.0), 0.0, [0.0] * n
    order = np.random.default_rng(5)
    for _ in range(3):
        for i in order.permutation(n):
            feats = rows[i].tolist()
            length = sum(r[f] ** 2 for f in feats) ** 0.5 + 1e-9
            x = {f: r[f] / length for f in feats}
            sign = 1 if labels[i] else -1
            slack = sign * (sum(w[f] * x[f] for f in feats) + b) - 1
            top = nbsvm.COST * n / (2 * (ones if labels[i] else n - ones)) * 10
            new = min(max(dual[i] - slack / 2, 0.0), top)
            for f in feats:
                w[f] += (new - dual[i]) * sign * x[f]
            b += (new - dual[i]) * sign
            dual[i] = new
    assert bias == pytest.approx(b) and all(weights[f] == pytest.approx(w[f] * r[f]) for f in range(30))


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_simhash_near_dedup", "op7_line_dedup", "op8_quality_rules", "op12_spelling_variants", "op13_toxicity"])
def test_queries_leave_no_tables_but_their_result(spark, tmp_path, name):
    shared = spark.conf.get("spark.checkpoint.dir")
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus()[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(os.listdir(shared))
    out = queries.queries()[name](spark, str(tmp_path))
    out.collect()
    left = [f for f in set(os.listdir(shared)) - before if f.startswith(("stash-", "run-"))]
    assert len(left) <= 1, left  # what the result reads


def test_scopes_of_threads_are_their_own(spark):
    from threading import Thread

    kept = []
    with scope(spark) as written:
        gone = stash(spark.range(3).toDF("x"))

        def other():
            with scope(spark) as mine:
                kept.append(mine(spark.range(5).toDF("x")))

        t = Thread(target=other)
        t.start()
        t.join()
        assert gone.count() == 3
        kept.append(written(spark.range(2).toDF("x")))
    assert [k.count() for k in kept] == [5, 2]
