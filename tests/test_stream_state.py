"""The state of a discovery stream as deltas with compaction, and a stream that follows it."""

from pyspark.sql import functions as F

from loglattice.operators import catalogue as cat
from loglattice.sources import io
from loglattice.streaming import streams


def _batch(spark, state, number, words, old):
    """What ``discover`` hands over for a batch that adds entries for ``words`` and matches the entries in ``old`` once each."""
    seed = state.catalogue(number)
    known = 0 if seed is None else seed.count()
    new = cat.entries(spark.createDataFrame([(f"{w} <*>", (1 << 40) + 7 * i) for i, w in enumerate(words)], "template string, insert_seq long"))
    whole = new if seed is None else seed.select(*new.columns).unionByName(new)
    matched = spark.createDataFrame([((1 << 40) + 7 * i,) for i in range(len(words)) for _ in range(2)] + [(e,) for e in old] + [(None,)], "entry long")
    saved = io.Saved(spark)
    state.add(number, whole, matched, known, 1 << 40, saved)
    ids = spark.createDataFrame([(f"{w} <*>", f"E{known + i + 1}") for i, w in enumerate(words)], "EventTemplate string, EventId string")
    ids.write.mode("overwrite").parquet(f"{state.folder}/ids/v={number}")
    saved.clear()
    state.compact(number)


def test_deltas_compaction_and_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT", 2)
    state = streams.State(spark, str(tmp_path / "s"))
    words = [["a", "b"], ["c"], ["d"], ["e"], ["f"], ["g"]]
    for n, some in enumerate(words):
        _batch(spark, state, n, some, [0] if n else [])
    _batch(spark, state, 5, words[5], [0])  # replayed just after it was compacted
    got = {r["template"]: (r["insert_seq"], r["match_frequency"]) for r in state.catalogue().collect()}
    assert got == {f"{w} <*>": (i, 7 if i == 0 else 2) for i, w in enumerate("abcdefg")}
    assert {tuple(r) for r in state.ids().collect()} == {(f"{w} <*>", f"E{i + 1}") for i, w in enumerate("abcdefg")}
    assert io.complete(spark, f"{state.folder}/base") == ["v=3", "v=5"] and io.complete(spark, f"{state.folder}/entries") == ["v=4", "v=5"]
    assert spark.read.parquet(f"{state.folder}/entries/v=5").count() == 2  # one new entry, one count


def test_apply_stream_follows_the_catalogue(spark, tmp_path):
    state, out = streams.State(spark, str(tmp_path / "s")), str(tmp_path / "out")
    frame = spark.readStream.schema("LineId long, Content string").parquet(str(tmp_path / "in*"))
    for n, word in enumerate(["none", "a", "b"]):
        spark.createDataFrame([(10 * n + i, f"{w} {i}") for i, w in enumerate("ab")], "LineId long, Content string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        if n:
            _batch(spark, state, n, [word], [])
        streams.apply_stream(frame, state.folder, out, str(tmp_path / "cp")).awaitTermination()
    got = {r["LineId"]: (r["EventId"], r["ParameterList"]) for r in spark.read.parquet(out).filter(F.col("EventId").isNotNull()).collect()}
    assert got == {10: ("E1", ["0"]), 20: ("E1", ["0"]), 21: ("E2", ["1"])}
    assert spark.read.parquet(out).count() == 6
