"""Exact removal of repeats: kept bytes and digests, forced collisions, hot anchors, repeated ids, batches of few rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import corpus, frame

from loglattice.llm import phrases, radix, repeats


def bytes_digest(rows):
    out = []
    for r in rows:
        gone = sum(x["e"] - x["s"] for x in r["removed"])
        out.append((r["doc_id"], len(r["kept"]) + gone, gone, len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(out)


def word_digest(rows):
    return sorted((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows)


def boilerplate(seed=6, n=400):
    """A sentence of 12 words in many texts of their own, and one of 30 words in a third of them."""
    r = random.Random(seed)
    words = lambda k: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(k))
    short, long = words(12), words(30)
    return [(i, f"{words(25)} {short} {words(25)} {long if i % 3 == 0 else ''} {words(5)}") for i in range(n)]


@pytest.mark.parametrize("rows", [corpus(), boilerplate()], ids=["mixed", "boilerplate"])
def test_whole_digests(spark, rows):
    assert bytes_digest(radix.dedup_bytes(frame(spark, rows)).collect()) == sorted(radix.brute(rows))
    assert word_digest(phrases.dedup_phrases(frame(spark, rows), shard_chars=8000).collect()) == sorted(phrases.brute(rows))


def test_every_anchor_hot_and_few_rows_at_a_time(spark, monkeypatch):
    """All spans meet as single windows; tasks get small batches, so that every carry between batches is used."""
    rows = corpus()[:24] + boilerplate(n=40)[:40]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(repeats, "SHARE", 1)
        every = lambda docs, encode, size, gram: _all_anchors(docs, encode, size, gram)
        for hot in (repeats.hot_anchors, every):
            monkeypatch.setattr(repeats, "hot_anchors", hot)
            assert bytes_digest(radix.dedup_bytes(frame(spark, rows)).collect()) == sorted(radix.brute(rows))
            assert word_digest(phrases.dedup_phrases(frame(spark, rows), shard_chars=8000).collect()) == sorted(phrases.brute(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _all_anchors(docs, encode, size, gram):
    found = [repeats.spans(encode(r["text"].encode()), size, gram) for r in docs.select("text").collect()]
    return np.unique(np.concatenate([f[3] for f in found if f is not None]))


def test_bytes_decide_where_hashes_collide(spark):
    """With codes for two kinds of bytes only, different stretches have equal hashes everywhere; the result is the same."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus()[:16])] + [(50, "ab" * 90), (51, "ac" * 90), (52, "ac" * 60)]
    codes = lambda text: repeats.bytes_to_codes(bytes(b & 2 for b in text))
    assert bytes_digest(radix.dedup_bytes(frame(spark, rows), encode=codes).collect()) == sorted(radix.brute(rows))


def test_passes_equal_sorting():
    r = np.random.default_rng(3)
    data = r.integers(0, 2, 4000).astype(np.uint8)
    at = r.integers(0, 3900, 500)
    for size in (1, 8, 13, 100):
        got = radix.passes(data, at, np.full(500, size), np.zeros(500, np.int64))
        texts = [data[a : a + size].tobytes() for a in at]
        assert len(set(zip(texts, got.tolist(), strict=True))) == len(set(texts)) == len(set(got.tolist()))


def test_repeated_ids_and_rows(spark):
    base = "the quick brown fox jumps over a lazy dog " * 1 + " ".join(f"w{i}" for i in range(40))
    rows = [(5, base), (5, base), (5, "own start " + base), (None, base), (9, base), (9, base)]
    got = radix.dedup_bytes(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, len(r["kept"])) for r in got) == sorted([(5, 0), (5, 0), (5, len("own start ")), (-1, len(base)), (9, 0), (9, 0)])
    got = phrases.dedup_phrases(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == sorted([(5, 49), (5, 49), (5, 49), (-1, 0), (9, 49), (9, 49)])


def test_hot_anchors_are_dealt_out(spark):
    """With a 12-word sentence in every text no task of the windows' exchange gets far more rows than the median."""
    rows = boilerplate(n=3000)
    own = radix.placed(frame(spark, rows).repartition(8))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = repeats.hot_anchors(own, phrases._encode, 20, 7)
        assert len(hot)
        spans = repeats.scan_spans(own, phrases._encode, 20, 7, hot, content=True).repartition("deal")
        sizes = sorted(r["count"] for r in spans.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 5 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
