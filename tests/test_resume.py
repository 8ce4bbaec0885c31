"""A run that is stopped and goes on from its last finished wave."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loglattice.options import Options
from loglattice.plans import discover as plan
from loglattice.plans.discover import discover


def _logs(spark):
    """Seven chunks: waves of 1, 2 and 4; templates of their own in each, one that comes again, nulls."""
    kinds = [("job", "done"), ("user", "came"), ("disk", "full")]
    rows = [(i, None if i % 50 == 49 else f"{kinds[i % 3][0]} c{i // 100} {i} {kinds[i % 3][1]}" if i % 3 else f"always {i} here") for i in range(700)]
    return spark.createDataFrame(rows, "row_nr long, Content string")


def _asker(log):
    def call(lists):
        with open(log, "a") as f:
            f.write(lists[0][0].split(" ")[0] + " " + "|".join(sorted(lists[0])) + "\n")
        one = lists[0][0].split(" ")
        return [(" ".join("<OID>" if w.isdigit() else w for w in one), 3, 1)]

    return call


def _rows(frame):
    return sorted(map(repr, frame.collect()))


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    dies = 2
    logs, folder = _logs(spark), f"{tmp_path}/run"
    want = discover(logs, Options(chunk_size=100), _asker(f"{tmp_path}/plain"))
    whole, waves, calls = plan._wave, [], []

    def wave(run, left):
        waves.append(left.agg(F.min("chunk_id"), F.max("chunk_id")).first()[:])
        out = whole(run, left)
        calls.append(1)
        if len(calls) == dies:  # the wave's answers are stored, its matches are not in the manifest
            raise KeyboardInterrupt
        return out

    monkeypatch.setattr(plan, "_wave", wave)
    options = Options(chunk_size=100, resume=folder)
    with pytest.raises(KeyboardInterrupt):
        discover(logs, options, _asker(f"{tmp_path}/resumed"))
    with pytest.raises(ValueError, match="other options"):
        discover(logs, Options(chunk_size=50, resume=folder), _asker(f"{tmp_path}/resumed"))
    found = discover(logs.limit(0), options, _asker(f"{tmp_path}/resumed"))  # its lines are those it began with
    assert waves == [(0, 0), (1, 2), (3, 6)][:dies] + [(0, 0), (1, 2), (3, 6)][dies - 1 :]
    assert _rows(found.result) == _rows(want.result) and _rows(found.catalogue.drop("insert_seq")) == _rows(want.catalogue.drop("insert_seq"))
    asked = [Counter(open(f"{tmp_path}/{n}").read().splitlines()) for n in ("plain", "resumed")]
    assert asked[0] == asked[1] and max(asked[1].values()) == 1
    assert not os.path.exists(f"{folder}/state") and not os.path.exists(f"{folder}/answers")
    found.tables.clear()
    want.tables.clear()
    assert not [n for _, _, names in os.walk(folder) for n in names if n.endswith(".parquet")]
