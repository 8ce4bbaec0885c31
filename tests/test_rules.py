"""Goldens of the string rules and of partitioning, made by hand from the published rules."""

import pytest
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.operators import catalogue as cat
from loglattice.operators import partition, slots
from loglattice.sources.io import Saved

CORRECT = {
    "  a   b ": "a b", "open /var/log/x.log: ok": "open <*>: ok", "retry 12 of 30": "retry <*> of <*>", "user12<*> in": "<*> in",
    "ip <*>.<*>.<*>.<*> up": "ip <*> up", "id #<*># and #<*> end": "id <*> and <*> end", "#<*># #<*>#": "#<*># #<*>#", "<*>:<*>#<*> x": "<*> x",
    "<*>/<*>@<*> y": "<*> y", 'say "<*>" now': "say <*> now", "list <*> <*> <*> <*> <*> end": "list <*> end", "four <*> <*> <*> <*> end": "four <*> <*> <*> <*> end",
    "load 3.5 v2": "load <*> v2", "a<*>/b c": "a<*>/b c",
}


def test_correction(spark):
    df = spark.createDataFrame([(k, v) for k, v in CORRECT.items()], "t string, want string")
    assert {r[0]: r[2] for r in df.select("t", "want", text.correct(F.col("t"))).collect()} == CORRECT


def test_placeholders(spark):
    df = spark.createDataFrame([("Connecting to <LOI>:<SID> as user <OID>",), ("x <LOI> {y} <> <foo>",)], "r string")
    got = [tuple(r) for r in df.select(text.finish(F.col("r")), text.slot_types(F.col("r"))).collect()]
    assert got == [("Connecting to <*> as user <*>", ["LOI", "SID", "OID"]), ("x <*> <*> <*> <*>", ["LOI"])]


def test_tokens_split_at_unicode_blanks(spark):
    df = spark.createDataFrame([("a b=c:d,e  f",), ("=: ,",)], "c string")
    assert [r[0] for r in df.select(text.tokens(F.col("c"))).collect()] == [["a", "b", "c", "d", "e", "f"], []]


@pytest.mark.parametrize(
    "nus,want",
    [([1, 7, 7, 2], (1, 2)), ([1, 2, 3, 2, 3], (1, 3)), ([1, 2, 3, 4], (1, 2)), ([1, 3, 2, 9], (2, 1)), ([5, 6, 5, 6, 2], (4, 0)), ([1, 1, 1], None), ([3, 1], (0, 1)), ([4], None), ([1, 1, 4], None)],
)
def test_position_pair(spark, nus, want):
    df = spark.createDataFrame([([(i, n) for i, n in enumerate(nus)],)], "nus array<struct<pos:int,nu:bigint>>")
    got = df.select(partition.position_pair(F.col("nus"))).first()[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "pairs,ordered,static",
    [
        (["ap", "ap", "bq", "bq"], {"v1a": [0, 1], "v1b": [2, 3]}, {"v1a": [0, 1], "v1b": [2, 3]}),
        (["ap", "aq", "bp", "bq"], {"": [0, 1, 2, 3]}, {"": [0, 1, 2, 3]}),
        (["ap", "bp", "cq", "cr"], {"v2p": [0], "v1b": [1], "v1c": [2, 3]}, {"v2p": [0, 1], "v1c": [2, 3]}),
        (["ap"] * 5 + ["aq"] * 5 + ["br"], {"v2p": [0, 1, 2, 3, 4], "v1a": [5, 6, 7, 8, 9], "v1b": [10]}, {"v2p": [0, 1, 2, 3, 4], "v2q": [5, 6, 7, 8, 9], "v1b": [10]}),
    ],
)
def test_third_step(spark, pairs, ordered, static):
    rows = [(0, 4, 0, None, p[0], p[1], i) for i, p in enumerate(pairs)]
    df = spark.createDataFrame(rows, "chunk_id long, token_len int, s2_pos int, s2_value string, v1 string, v2 string, row_nr long")
    table = df.groupBy(*partition.PART, "v1", "v2").agg(F.count("*").alias("n"), F.min("row_nr").alias("first"))
    for found, want in ((partition.relations_in_order(table, 0.25, Saved(spark)), ordered), (partition.relations(table, 0.25), static)):
        side = {(r["v1"], r["v2"]): r["s3_side"] for r in found.collect()}
        got = {}
        for i, p in enumerate(pairs):
            s = side[p[0], p[1]]
            got.setdefault("" if s is None else s + (p[0] if s == "v1" else p[1]), []).append(i)
        assert got == want


def test_slot_rule(spark):
    cases = [(["1", "22"], "OBA", True, r"\d+"), (["1f", "a0"], "CRS", True, "[0-9a-fA-F]+"), (["1", "2"], "OID", True, r"\S+"), (["1"], "OTP", True, ".+")]
    cases += [(["x y"], "OTP", False, ".+?"), ([], "TDA", True, ".+"), ([], "OID", True, r"\S+")]
    df = spark.createDataFrame(cases, "v array<string>, kind string, trailing boolean, want string")
    assert not df.filter(slots.slot_regex(F.col("v"), F.col("kind"), F.col("trailing")) != F.col("want")).collect()


def test_cheapest_match_wins(spark):
    entries = cat.entries(spark.createDataFrame([("user <*> in", 0, 0), ("<*> bob in", 0, 1), ("user <*> <*>", 9, 2), ("<*> b", 1, 3), ("a <*>", 2, 4)], "template string, match_frequency long, insert_seq long"))
    lines = spark.createDataFrame([(0, "user bob in"), (1, "a b"), (2, "zzz"), (3, None)], "row_nr long, Content string")
    got = {r["row_nr"]: (r["EventTemplate"], r["ParameterList"]) for r in cat.match(lines, entries).collect()}
    assert got == {0: ("user <*> in", ["bob"]), 1: ("a <*>", ["b"]), 2: (None, None), 3: (None, None)}
    joined = {r[0]: r[1] for r in cat.match_by_join(lines, entries).collect()}
    assert joined == {0: "user <*> in", 1: "a <*>"}


def test_listed(spark):
    df = spark.createDataFrame([(["127.0.0.1", "8000"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(text.listed(F.col("c"))).collect()] == ["['127.0.0.1', '8000']", None, None]


def test_chunk_size(spark):
    want = {1000: 3000, 20000: 3000, 100000: 12000, 1000000: 24500, 16000000: 40000, 99000000: 40000}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert {r[0]: r[1] for r in df.select("n", text.chunk_size(F.col("n"))).collect()} == want
