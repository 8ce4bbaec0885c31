"""Large catalogues through the inverted index, and reconcile in few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import catalogue as cat
from loglattice.sources.io import Saved


def _random(seed, n, m):
    """Random templates (some loose, some slot-free, some equal in rank) and lines, most of which some template matches."""
    r = random.Random(seed)
    words = ["open", "close", "user", "path:", "a=b", "x,y", "disk", "end"]
    templates = []
    for _ in range(n):
        t = [r.choice(["<*>", "<*>", f"{r.choice(words)}<*>", r.choice(words), r.choice(words), f"id{r.randint(0, 30)}"]) for _ in range(r.randint(1, 5))]
        templates.append(" ".join(t))
    lines = []
    for _ in range(m):
        t = r.choice(templates)
        while "<*>" in t:
            t = t.replace("<*>", r.choice(["7", "disk", "a=b", "zz", "id3"]), 1)
        lines.append(t if r.random() < 0.9 else t + " tail")
    return templates, [*lines, "", "   "]


@pytest.mark.parametrize("slice_", [5, 20_000])
def test_index_equals_join_and_slices(spark, monkeypatch, slice_):
    monkeypatch.setattr(cat, "SLICE", slice_)
    templates, lines = _random(slice_, 120, 300)
    catalogue = cat.entries(spark.createDataFrame([(t, k) for k, t in enumerate(templates)], "template string, insert_seq long"))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lines)] + [(9999, None)], "row_nr long, Content string")
    told = {r.row_nr: r.EventTemplate for r in cat.match_by_join(rows, catalogue).collect()}
    by_key = {r.row_nr: (r.EventTemplate, r.ParameterList) for r in cat.match_by_key(rows, catalogue).collect()}
    assert len(by_key) == len(lines) + 1
    assert {k: t for k, (t, _) in by_key.items() if t is not None} == told
    assert {r.row_nr: (r.EventTemplate, r.ParameterList) for r in cat.match(rows, catalogue).collect()} == by_key
    for t, v in by_key.values():  # what was captured rebuilds the line's length
        assert t is None or len(v) == t.count("<*>")


def test_index_keeps_the_order_of_own_entries(spark, monkeypatch):
    templates, lines = _random(3, 60, 200)
    catalogue = cat.entries(spark.createDataFrame([(t, k) for k, t in enumerate(templates)], "template string, insert_seq long"))
    r = random.Random(1)
    rows = spark.createDataFrame([(k, t, r.randrange(60)) for k, t in enumerate(lines)], "row_nr long, Content string, own long")
    want = {x.row_nr: (x.EventTemplate, x.entry) for x in cat.match(rows, catalogue, "own", True).collect()}
    hits = {tuple(x) for x in cat.hits(rows, catalogue, "own").select("own", F.col("hits").cast("string")).collect()}
    monkeypatch.setattr(cat, "SLICE", 4)
    assert {x.row_nr: (x.EventTemplate, x.entry) for x in cat.match(rows, catalogue, "own", True).collect()} == want
    assert {tuple(x) for x in cat.hits(rows, catalogue, "own").select("own", F.col("hits").cast("string")).collect()} == hits


def test_a_large_catalogue_takes_one_pass(spark):
    """200,000 entries: one join, no slices (each has a rare token of its own); lines meet one or two candidates."""
    n = 200_000
    made = spark.range(n).select(F.concat(F.lit("job j"), "id", F.lit(" on <*> took <*> ms")).alias("template"), F.col("id").alias("insert_seq"))
    catalogue = cat.entries(made)
    lines = spark.range(20_000).select(F.col("id").alias("row_nr"), F.concat(F.lit("job j"), F.col("id") * 10, F.lit(" on node7 took 5 ms")).alias("Content"))
    listed = cat.index(catalogue)
    assert listed.filter("key is null").isEmpty() and cat.candidates(lines, listed).count() == 20_000
    out = cat.match(lines, catalogue)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.filter(F.col("EventTemplate") == F.concat(F.lit("job j"), F.col("row_nr") * 10, F.lit(" on <*> took <*> ms"))).count() == 20_000


def _plain(seen):
    kept = set()
    for own in sorted({o for o, _ in seen}):
        if any(own in h and not any(e in kept for e in h if e != own) for o, h in seen if o == own):
            kept.add(own)
    return kept


@pytest.mark.parametrize("at_once", [0, 200_000])
def test_reconcile_equals_a_plain_pass(spark, monkeypatch, at_once):
    monkeypatch.setattr(cat, "AT_ONCE", at_once)
    r = random.Random(at_once)
    seen = {(own, tuple(sorted({r.randrange(own + 1) for _ in range(r.randint(1, 4))} | ({own} if r.random() < 0.8 else set())))) for own in range(40) for _ in range(3)}
    frame = spark.createDataFrame([(o, list(h)) for o, h in seen], "own long, hits array<long>")
    assert {x.own for x in cat.useful(frame, "own", Saved(spark)).collect()} == _plain(seen)


def test_a_long_chain_takes_few_jobs(spark):
    """1,000 entries, each of which shares its line with the one before."""
    frame = spark.createDataFrame([(0, [0])] + [(k, [k - 1, k]) for k in range(1, 1000)], "own long, hits array<long>")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        out = cat.useful(frame, "own", Saved(spark))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {x.own for x in out.collect()} == set(range(0, 1000, 2))
    assert len(jobs) <= 16  # AQE runs a job for each exchange; six tables are written or counted, however long the chain is
