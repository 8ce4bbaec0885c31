"""Lines are dealt to all cores, whatever file they come from, and aren't shuffled by the few keys of their leaves."""

import random

from loglattice.operators import partition
from loglattice.options import Options
from loglattice.plans.discover import discover
from loglattice.sources import io
from pyspark.sql import functions as F


def _in_one_row_group(spark, tmp_path):
    """A file of one row group that Spark cuts in many parts, of which one has rows."""
    rows = spark.range(4000).select(F.col("id").alias("row_nr"), F.concat(F.when(F.col("id") % 3 == 0, "Job a-").otherwise("Run b-"), "id", F.lit(" ends at step "), F.col("id") % 7).alias("Content"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return spark.read.parquet(str(tmp_path / "in"))


def _spied(monkeypatch, wanted):
    """The tables with the columns ``wanted`` that a run writes: parts with rows, and the plan."""
    seen, plain = [], io.Saved.__call__

    def call(self, df):
        out = plain(self, df)
        if wanted <= set(df.columns):
            parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
            seen.append((parts, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(io.Saved, "__call__", call)
    return seen


def _unset(spark):
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def test_spread_looks_at_rows_not_at_parts(spark, tmp_path):
    try:
        rows = _in_one_row_group(spark, tmp_path)
        assert rows.rdd.getNumPartitions() >= 8
        assert io.spread(rows).select(F.spark_partition_id().alias("p")).distinct().count() >= 6
    finally:
        _unset(spark)


def test_lines_of_a_wave_are_on_all_cores_and_find_their_leaf_without_a_shuffle(spark, tmp_path, monkeypatch):
    try:
        rows = _in_one_row_group(spark, tmp_path)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables of keys looked large
        seen = _spied(monkeypatch, {"row_nr", "Content", "own", "start"})
        found = discover(rows, Options(chunk_size=2000))
        assert found.matched.filter("EventTemplate is null").isEmpty() and found.matched.count() == 4000
        assert seen
        for parts, plan in seen:
            assert parts >= 6
            assert "SortMergeJoin" not in plan
    finally:
        _unset(spark)


def test_leaves_are_those_of_plain_counts(spark):
    draw = random.Random(5)
    kinds = [["x"], ["a", "b"], ["p", "q", "r"], list("stuvw")]
    words = [[draw.choice(k) for k in draw.sample(kinds, n)] for n in (0, 1, 2, 3, 4) for _ in range(60)]
    words += [[draw.choice("ab"), draw.choice("cde"), draw.choice("fgh"), draw.choice("ijklm"), draw.choice("nop"), "end"] for _ in range(80)]
    words += [[draw.choice("ab"), draw.choice("cd"), draw.choice("efg"), draw.choice("hij"), draw.choice("kl")] for _ in range(80)]
    lines = spark.createDataFrame([(i, i % 3, " ".join(w)) for i, w in enumerate(words)], "row_nr long, chunk_id long, Content string")
    vec = partition.vectors(partition.tokenise(lines))
    keys = ["chunk_id", "token_len"]
    split = partition.split_position(partition.cardinality(vec, keys), keys)
    want = vec.join(split, keys, "left").select("chunk_id", "words", "s2_pos", F.when(F.col("min_nu") > 1, F.get("words", F.col("s2_pos"))).alias("s2_value"))
    for saved in (None, io.Saved(spark)):
        part = partition.s2(vec, saved)
        got = part.select("chunk_id", "words", "s2_pos", "s2_value")
        assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        plain = partition.goodness(part).filter("goodness <= 0.3").select(*partition.PART, partition.position_pair(F.col("nus")).alias("pp")).filter("pp is not null")
        mine = partition.pairs_of(part, 0.3, saved)
        assert plain.count() == mine.count() > 0 and plain.exceptAll(mine).isEmpty()


def test_what_lines_match_is_written_once_and_read_in_one_scan(spark, monkeypatch):
    """Three waves, of which the first leaves a line that a later one explains; one line that nothing matches, and null lines."""
    seen, plain = [], io.Saved.__call__

    def named(lists):  # knows a line's kind if it is shown several
        known = {"Job": "Job <*> ends", "Late": "Late <*> came now"}
        return [known[lines[0].split(" ")[0]] if len(lines) > 1 else "nothing of this" for lines in lists]

    def call(self, df):
        out = plain(self, df)
        if {"row_nr", "EventTemplate"} <= set(df.columns):
            seen.append(out.filter("EventTemplate is not null").count())
        return out

    monkeypatch.setattr(io.Saved, "__call__", call)
    rows = [(i, None if i % 10 == 9 else f"Job {i} ends" if i != 3 and i < 1000 else "Late 3 came now" if i == 3 else "odd one of them all" if i == 1500 else f"Late {i} came now") for i in range(2000)]
    lines = spark.createDataFrame(rows, "row_nr long, Content string")
    found = discover(lines, Options(chunk_size=500, repool_passes=0, singleton_fallback=False, template_correction=False), named)
    known = {"Job": "Job <*> ends", "Late": "Late <*> came now"}
    want = {i: None if c is None or c.startswith("odd") else known[c.split(" ")[0]] for i, c in rows}
    assert {r[0]: r[1] for r in found.matched.select("row_nr", "EventTemplate").collect()} == want
    assert found.matched.count() == found.result.count() == len(rows)
    assert sum(seen) == sum(v is not None for v in want.values())
    # the waves' tables and that of the lines without a template
    assert found.matched._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 3
    assert found.stats.select("matched", "noise").first()[:] == (sum(seen), 1)
    found.tables.clear()
