"""Operator 13: gradients and scores against plain loops, interactions that no linear model has, held-out accuracy."""

import math

import numpy as np
import pytest

from loglattice.llm import toxicity
from loglattice.llm.common import identified


def _plain_margin(m, present):
    pairs = sum(float(np.dot(m.factors[i], m.factors[j])) for k, i in enumerate(present) for j in present[k + 1 :])
    return m.bias + sum(m.linear[i] for i in present) + pairs


def test_margin_and_gradient_equal_plain_sums():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), -0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = (rng.random((5, 6)) < 0.5).astype(float)
    y = np.array([0.0, 1, 1, 0, 1])
    for row in x:
        present = np.flatnonzero(row)
        assert m.margin(present) == pytest.approx(_plain_margin(m, list(present)))

    def loss():
        total = 0.0
        for row, t in zip(x, y, strict=True):
            z = _plain_margin(m, list(np.flatnonzero(row)))
            total += math.log(1 + math.exp(-z)) if t else math.log(1 + math.exp(z))
        return total / len(y) + 0.01 * (m.linear**2).sum() / 2 + 0.02 * (m.factors**2).sum() / 2

    bias, linear, factors = toxicity.gradient(m, x, y, 0.01, 0.02)
    for weights, grads in ((m.linear, linear), (m.factors, factors)):
        for at in np.ndindex(weights.shape):
            old = weights[at]
            weights[at] = old + 1e-5
            up = loss()
            weights[at] = old - 1e-5
            down = loss()
            weights[at] = old
            assert grads[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    m.bias += 1e-5
    up = loss()
    m.bias -= 2e-5
    assert bias == pytest.approx((up - loss()) / 2e-5, abs=1e-6)


def _interacting(n, seed):
    """Toxic is an insult with the mention of a group, and a compliment without one: no sum of single terms tells them."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(n):
        insult, group = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({int(insult), 2 + int(group), *rng.integers(4, 40, 8).tolist()})))
        labels.append(float(insult == group))
    return rows, np.array(labels)


def test_learns_what_only_pairs_tell():
    rows, labels = _interacting(1500, 1)
    m = toxicity.fit(np.arange(40), rows, labels)
    fresh, truth = _interacting(400, 2)
    told = np.array([m.margin(r) > 0 for r in fresh])
    assert (told == truth).mean() > 0.97
    alone = toxicity.Machine(m.buckets, m.bias, m.linear, np.zeros_like(m.factors))
    assert (np.array([alone.margin(r) > 0 for r in fresh]) == truth).mean() < 0.7


def _rows(n):
    rng = np.random.default_rng(4)
    plain, bad = [f"w{k}" for k in range(400)], ["vile", "fool", "dunce", "wretch"]
    docs, labels = [], []
    for k in range(n):
        words = rng.choice(plain, int(rng.integers(5, 400))).tolist()
        toxic = k % 7 == 0
        if toxic:
            for w in rng.choice(bad, int(rng.integers(1, 4))):
                words.insert(int(rng.integers(0, len(words))), str(w))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_query_holds_out_a_fold_and_finds_toxic_rows(spark, tmp_path):
    docs, labels = _rows(1400)
    extra = [(None, "vile text"), (5000, None), (5001, ""), (5002, "w1 " * 60_000 + "dunce " + "w2 " * 60_000 + "fool"), (0, docs[0][1]), (3, "another text of one id")]
    spark.createDataFrame([(d, t, "s", 1.0) for d, t in docs + extra], "doc_id long, text string, y string, score double").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op13(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {d: t for d, _, t in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert 150 < len(held) and sum(a == b for a, b in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5002].predicted == 1 and by_id[None].predicted == 1 and not by_id[None].held_out
    assert 0 < by_id[5000].score == by_id[5001].score < 0.5
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_scores_equal_a_plain_loop_and_samples_are_bounded(spark):
    docs, labels = _rows(300)
    frame = identified(spark.createDataFrame(docs, "doc_id long, text string"))
    m = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), evidence=3.0)
    assert len(m.buckets)
    place = {int(b): k for k, b in enumerate(m.buckets)}
    for r in toxicity.score(frame, m).collect()[:40]:
        present = sorted({place[b] for w in docs[r.doc_id][1].lower().split() if (b := toxicity.bucket(w)) in place})
        assert r.score == pytest.approx(1 / (1 + math.exp(-_plain_margin(m, present))))
    small = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=5, evidence=0.0)
    assert len(small.buckets) <= 5 * 400


def test_copies_of_one_toxic_text_make_no_evidence(spark):
    """Near copies share their neighbourhoods, so their words are counted once."""
    base = " ".join(f"n{k}" for k in range(60))
    docs = [(k, f"{base} tail{k}") for k in range(60)] + [(100 + k, f"p{k} q{k % 9} r{k % 5}") for k in range(300)]
    labels = [(d, 1, int(d < 100)) for d, _ in docs]
    frame = identified(spark.createDataFrame(docs, "doc_id long, text string"))
    m = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not {toxicity.bucket(f"n{k}") for k in range(1, 59)} & set(m.buckets.tolist())


def test_without_usable_labels_the_score_is_a_constant(spark):
    docs = identified(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 9) for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).collect() == []
