"""Samples of lines, the store of answers, the bound on calls, prompts, and what runs leave behind."""

import os
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loglattice.operators import propose
from loglattice.options import Options
from loglattice.plans.discover import discover
from loglattice.sources import io


def test_a_leaf_of_one_vector_shows_lines(spark, tmp_path):
    """200 lines of one token vector: the proposer sees ten of them."""
    rows = [(k, "status: ok" if k % 2 else "status=ok") for k in range(200)]

    def note(lists):
        with open(f"{tmp_path}/seen", "a") as f:
            f.write(f"{len(lists[0])} {len(set(lists[0]))}\n")
        return ["status: ok"]

    discover(spark.createDataFrame(rows, "row_nr long, Content string"), Options(repool_passes=0, singleton_fallback=False), note)
    assert open(f"{tmp_path}/seen").read() == "10 2\n"


def test_drawn_lines_are_those_of_smallest_place(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("row_nr"), F.when(F.col("id") < 3990, F.lit("big")).otherwise(F.lit("few")).alias("own"))
    sizes = rows.groupBy("own").agg(F.count("*").alias("n"))
    got = {(r.own, r.row_nr, r.rank) for r in propose.drawn(rows, "own", sizes, 12).collect()}
    import hashlib

    want = set()
    for own, ids in (("big", range(3990)), ("few", range(3990, 4000))):
        order = sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        want |= {(own, i, k + 1) for k, i in enumerate(order[:12])}
    assert got == want
    wrong = sizes.withColumn("n", F.col("n") * 1000)  # the share is far too small: keys are drawn again
    assert {(r.own, r.row_nr, r.rank) for r in propose.drawn(rows, "own", wrong, 12).collect()} == want


def _leaves(spark, n):
    return spark.createDataFrame([(k, [f"line {k} a", f"line {k} b"]) for k in range(n)], "leaf long, samples array<string>")


def test_answers_are_kept_and_asked_for_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(propose, "SLICE_LEAVES", 6)
    store, log = f"{tmp_path}/store", f"{tmp_path}/log"

    def model(dies):
        def call(lists):
            with open(log, "a") as f:
                f.write(lists[0][0] + "\n")
            if "line 7 " in lists[0][0]:
                raise ValueError("no answer")
            return [(lists[0][0].replace("a", "<*>"), 5, 2)]

        return call

    grouped = _leaves(spark, 40).unionByName(_leaves(spark, 1).withColumn("leaf", F.lit(99).cast("long")))
    first = propose.ask(grouped, model(False), 3, store=store).collect()
    asked = open(log).read().splitlines()
    assert sorted(asked) == sorted(f"line {k} a" for k in range(40))  # equal samples are asked for once
    assert {r.leaf: r.raw_template for r in first} == {k: f"line {k} <*>" if k != 7 else "line 7 a" for k in range(40)} | {99: "line 0 <*>"}
    totals = propose.call_totals(spark.createDataFrame(first)).first()
    assert tuple(totals) == (40, 39 * 5, 39 * 2)
    again = propose.ask(grouped, model(False), 3, store=store)
    assert open(log).read().splitlines()[40:] == ["line 7 a"]  # only what failed
    assert propose.call_totals(again).first().llm_calls == 1


def test_no_leaf_of_a_finished_slice_is_asked_twice(spark, tmp_path, monkeypatch):
    """A worker dies midway, and then the whole run: its slice is asked for again, finished ones aren't."""
    monkeypatch.setattr(propose, "SLICE_LEAVES", 5)
    store, log, flag = f"{tmp_path}/store", f"{tmp_path}/log", f"{tmp_path}/die"
    open(flag, "w").close()

    def model(lists):
        with open(log, "a") as f:
            f.write(lists[0][0] + "\n")
        return [None if False else lists[0][0]]

    original = propose._answer

    def dying(proposer, lines, seconds):
        if os.path.exists(flag) and len(open(log).read().splitlines() if os.path.exists(log) else []) >= 12:
            raise RuntimeError("the worker is lost")
        return original(proposer, lines, seconds)

    monkeypatch.setattr(propose, "_answer", dying)
    with pytest.raises(Exception, match="the worker is lost"):
        propose.ask(_leaves(spark, 30), model, 1, store=store)
    finished = {r.question for r in spark.read.parquet(store).collect()}
    before = open(log).read().splitlines()
    assert 0 < len(finished) <= 12 <= len(before) < 30
    os.remove(flag)
    out = propose.ask(_leaves(spark, 30), model, 1, store=store).collect()
    after = open(log).read().splitlines()[len(before) :]
    assert len(out) == 30 and not any(r.failed for r in out)
    assert len(after) == 30 - len(finished) == len(set(after))


def test_calls_alive_are_bounded_though_they_time_out(spark, tmp_path):
    """Calls that never end are ended, so no more than max_concurrent beat at any time."""

    def model(lists):
        while True:
            with open(f"{tmp_path}/beats", "a") as f:
                f.write(f"{time.time():.2f} {os.getpid()}\n")
            time.sleep(0.02)

    start = time.time()
    out = propose.ask(_leaves(spark, 12), model, 3, seconds=0.4).collect()
    assert len(out) == 12 and all(r.failed and r.raw_template == r.samples[0] for r in out)
    time.sleep(0.3)
    beats = [x.split() for x in open(f"{tmp_path}/beats").read().splitlines()]
    spans = defaultdict(list)
    for at, pid in beats:
        spans[pid].append(float(at))
    assert len(spans) == 12 and all(max(v) - min(v) < 1.5 for v in spans.values())
    ends = [(min(v), max(v)) for v in spans.values()]
    for at, _ in ends:
        assert sum(a <= at <= b for a, b in ends) <= 3
    assert time.time() - max(b for _, b in ends) > 0.2 and start < min(a for a, _ in ends)


def test_prompts_of_the_options_reach_the_model(spark, tmp_path):
    def model(prompt):
        with open(f"{tmp_path}/prompts", "a") as f:
            f.write(prompt + "\n")
        return "job <*> done"

    rows = spark.createDataFrame([(k, f"job {k} done") for k in range(20)], "row_nr long, Content string")
    found = discover(rows, Options(prompt="Say it of:\n{}\nNow.", sample_n=3, answers=f"{tmp_path}/answers"), model=model)
    assert [r.template for r in found.catalogue.collect()] == ["job <*> done"]
    assert open(f"{tmp_path}/prompts").read().startswith("Say it of:\njob ")
    calls = len(open(f"{tmp_path}/prompts").read().split("Now."))
    again = discover(rows, Options(prompt="Say it of:\n{}\nNow.", sample_n=3, answers=f"{tmp_path}/answers"), model=model)
    assert again.stats.first().llm_calls == 0 and len(open(f"{tmp_path}/prompts").read().split("Now.")) == calls


def test_a_run_leaves_only_what_its_results_read(spark):
    shared = io.shared_folder(spark)
    tables = lambda: {d for d, _, f in os.walk(shared) if "_SUCCESS" in f and "/run-" in d}
    before = tables()
    found = discover(spark.createDataFrame([(k, f"job {k % 7} done") for k in range(50)], "row_nr long, Content string"))
    assert found.result.count() == 50
    assert len(tables() - before) <= 3
    found.tables.clear()
    assert tables() == before
