"""Jobs as a whole: discovery, streams, files."""


from loglattice.operators import partition
from loglattice.options import Options
from loglattice.plans import views
from loglattice.plans.discover import discover
from loglattice.sources import io
from loglattice.streaming import streams

SF = "/root/testdata/sf0.001"


def test_every_line_is_in_one_leaf(spark):
    lines = partition.tokenise(views.customers(spark, SF))
    for static in (True, False):
        got = partition.assignment(lines, partition.leaves(partition.vectors(lines), static=static))
        assert got.count() == lines.count() == got.select("row_nr").distinct().count()


def test_discover_keeps_rows_and_rebuilds_lines(spark):
    logs = views.logs(spark, SF).select("row_nr", "LineId", "Content")
    odd = spark.createDataFrame([(10**6, 10**6, None), (10**6 + 1, 10**6 + 1, "=: ,"), (10**6 + 2, 10**6 + 2, "lonely line 7 here")], logs.schema)
    found = discover(logs.unionByName(odd), Options())
    rows = found.result.collect()
    assert len(rows) == logs.count() + 3
    for r in rows:
        if r["EventTemplate"] is not None:
            parts, out = r["EventTemplate"].split("<*>"), ""
            for i, p in enumerate(parts):
                out += p + (r["ParameterList"][i] if i < len(parts) - 1 else "")
            assert out == r["Content"]
    by_id = {r["LineId"]: r for r in rows}
    assert by_id[10**6]["EventTemplate"] is None
    assert by_id[10**6 + 2]["EventTemplate"] is not None
    stats = found.stats.first()
    assert stats["matched"] + stats["noise"] == len(rows) - 1


def test_custom_proposer_and_failures(spark):
    logs = spark.createDataFrame([(i, f"job {i} done") for i in range(6)] + [(9, "plain")], "row_nr long, Content string")
    found = discover(logs, Options(), proposer=lambda lists: ["job <OID> done" if s[0].startswith("job") else None for s in lists])
    assert {r["EventTemplate"] for r in found.result.collect()} == {"job <*> done", "plain"}


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    data = views.logs(spark, SF).select("row_nr", "LineId", "Content")
    data.repartition(2).write.parquet(str(tmp_path / "in"))
    frame = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for n in range(2):
        streams.discover_stream(frame, str(tmp_path / "out"), str(tmp_path / f"cp{n}"), Options()).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out/result")).select("LineId", "EventTemplate")
        want = discover(data, Options()).result.select("LineId", "EventTemplate")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_files(spark, tmp_path):
    result = spark.createDataFrame([(2, "E1", 'say "x", y', "say <*>", ["a", "b"], []), (1, None, "line\nbreak", None, None, None)], "LineId long, EventId string, Content string, EventTemplate string, ParameterList array<string>, SlotTypes array<string>")
    io.write_result(result, str(tmp_path / "r"), "csv")
    back = {r["LineId"]: r for r in io.read_parsed(spark, str(tmp_path / "r")).collect()}
    assert back[2]["ParameterList"] == "['a', 'b']" and back[2]["SlotTypes"] is None and back[1]["EventTemplate"] is None
    io.write_result(result, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    io.write_config(spark, Options(), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first()["repool_passes"] == 2
    numbered = io.row_index(spark.range(100).withColumnRenamed("id", "x"))
    assert sorted(r["row_nr"] for r in numbered.collect()) == list(range(100))
