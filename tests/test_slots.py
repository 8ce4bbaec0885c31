"""Captures and slot regexes as SQL expressions, against a regex that backtracks."""

import random
import time

import plain_slots
import pytest
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.operators import slots

SCHEMA = "id long, template string, samples array<string>, slot_types array<string>"


def _cases(seed, n=400):
    rnd = random.Random(seed)
    kinds = [*slots.SLOT_TYPES, "none"]
    for _ in range(n):
        parts = ["".join(rnd.choices("ab. ", k=rnd.choice((0, 0, 1, 1, 2)))) for _ in range(rnd.randint(1, 5))]
        lines = []
        for _ in range(rnd.randint(0, 5)):
            made = "".join(p + "".join(rnd.choices("ab1 f\n²é\x1c ", k=rnd.randint(0, 3))) for p in parts[:-1]) + parts[-1]
            lines.append(made if rnd.random() < 0.8 else "".join(rnd.choices("ab. 1", k=rnd.randint(0, 8))))
        yield "<*>".join(parts), lines, rnd.choices(kinds, k=rnd.randint(0, len(parts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_backtracking(spark, seed):
    cases = list(_cases(seed))
    df = slots.infer(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], SCHEMA))
    got = {r["id"]: r["slot_regexes"] for r in df.collect()}
    assert got == {i: plain_slots.inferred(*c) for i, c in enumerate(cases)}
    assert sum(len(v) for v in got.values()) > 500


def test_captures(spark):
    rows = [("<*>b<*>", "abbb"), ("<*><*><*>", "xyzé"), ("x<*>y", "xy"), ("x", "x"), ("x", "y"), ("<*> b", "𝒳 b"), ("a<*>a", "aa"), ("<*>", ""), ("<*>", None), ("a.c<*>", "abcd")]
    df = spark.createDataFrame(rows, "t string, line string").select(slots.captured(F.col("line"), text.literals(F.col("t"))))
    assert [r[0] for r in df.collect()] == [["a", "bb"], ["x", "y", "zé"], None, [], None, ["𝒳"], None, None, None, None]


def test_what_backtracks_forever_is_scanned_once(spark):
    template = "a".join(["<*>"] * 13) + "b"
    df = spark.createDataFrame([(0, template, ["a" * 5000 + "\n", "a" * 5000, "ab" * 13], [])], SCHEMA)
    began = time.monotonic()
    assert slots.infer(df).first()["slot_regexes"] == [r"\S+"] * 13
    assert time.monotonic() - began < 20


def test_no_samples_and_no_slots(spark):
    rows = [(0, "a <*>", [], ["OTP"]), (1, "a", ["a"], []), (2, "a <*> b", [None], ["OTP"]), (3, "<*>", None, None), (4, "", [""], [])]
    got = {r["id"]: r["slot_regexes"] for r in slots.infer(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: [".+"], 1: [], 2: [r"\S+"], 3: [r"\S+"], 4: []}


def test_no_python(spark):
    plan = slots.infer(spark.createDataFrame([(0, "a <*>", ["a b"], ["OTP"])], SCHEMA).filter("id >= 0"))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "EvalPython" not in plan
