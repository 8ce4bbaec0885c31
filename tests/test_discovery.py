"""Discovery with proposers, reconciling in order, dialects, pruning, streams."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.operators import catalogue as cat
from loglattice.operators import partition, propose, slots
from loglattice.operators.slots import compiled
from loglattice.options import Options
from loglattice.plans import views
from loglattice.plans.discover import discover
from loglattice.sources import io
from loglattice.streaming import streams

SF = "/root/testdata/sf0.001"
LOG = "row_nr long, Content string"


def test_one_call_for_one_leaf_of_many_chunks(spark):
    logs = spark.createDataFrame([(i, f"job {i} done") for i in range(2000)], LOG)
    found = discover(logs, Options(chunk_size=500), lambda lists: [("job <OID> done", 7, 2) for _ in lists])
    stats = found.stats.first()
    assert (stats["llm_calls"], stats["input_tokens"], stats["output_tokens"], stats["matched"], stats["noise"]) == (1, 7, 2, 2000, 0)
    assert [(r["template"], r["match_frequency"]) for r in found.catalogue.collect()] == [("job <*> done", 2000)]


def test_failed_and_slow_calls_touch_their_leaf_only(spark):
    logs = spark.createDataFrame([(0, "red a1 x"), (1, "red a2 x"), (2, "blue one two three"), (3, "slow a b c d"), (4, None)], LOG)

    def proposer(lists):
        first = lists[0][0].split(" ")[0]
        if first == "blue":
            raise RuntimeError
        if first == "slow":
            time.sleep(30)
        return ["red <OID> x"]

    start = time.time()
    found = discover(logs, Options(timeout=1.0, max_concurrent=1), proposer)
    assert time.time() - start < 29
    assert {r["Content"]: r["EventTemplate"] for r in found.result.collect()} == {
        "red a1 x": "red <*> x", "red a2 x": "red <*> x", "blue one two three": "blue one two three", "slow a b c d": "slow a b c d", None: None
    }


def test_catalogue_holds_the_templates_of_the_result(spark):
    logs = spark.createDataFrame([(i, f"{w} came {i} times to {w}") for i, w in enumerate("abcd")], LOG)
    found = discover(logs, Options(repool_passes=-1))
    got = {r["EventTemplate"] for r in found.result.collect()}
    assert got == {r["template"] for r in found.catalogue.collect()} == {f"{w} came <*> times to {w}" for w in "abcd"}
    again = discover(logs, Options(repool_passes=-1), lambda lists: 1 / 0, found.catalogue)
    assert again.stats.first()["llm_calls"] == 0 and {r["match_frequency"] for r in again.catalogue.collect()} == {2}


def in_order(lines, entries):
    """Reconcile by plain loops: entries kept, and the template of each line; lines are (own, text)."""
    known, out = [], {}
    cost = lambda e: (-sum(map(len, e[1].split("<*>"))), -e[1].count("<*>"), e[0])
    for seq, template in sorted(entries):
        new, used = (seq, template), False
        for i, (own, line) in enumerate(lines):
            if own == seq:
                fit = sorted((e for e in known if compiled(e[1], None).fullmatch(line)), key=cost)
                if fit:
                    out[i] = fit[0][1]
                elif compiled(template, None).fullmatch(line):
                    out[i], used = template, True
        if used:
            known.append(new)
    return {s for s, _ in known}, out


def test_reconcile_in_order(spark):
    golden = [(1, "user bob in"), (2, "user amy in"), (2, "user amy out")], [(1, "user <*> in"), (2, "user amy <*>")]
    kept, out = in_order(*golden)
    assert kept == {1, 2} and out == {0: "user <*> in", 1: "user <*> in", 2: "user amy <*>"}
    assert in_order(golden[0][:2], golden[1])[0] == {1}
    r = random.Random(4)
    cases = [golden]
    for _ in range(4):
        words = ["a", "b", "<*>"]
        entries = [(i + 1, " ".join(r.choice(words) for _ in range(3))) for i in range(12)]
        cases.append(([(r.randint(1, 12), " ".join(r.choice("abc") for _ in range(3))) for _ in range(40)], entries))
    for lines, entries in cases:
        frame = spark.createDataFrame([(i, own, t) for i, (own, t) in enumerate(lines)], "row_nr long, own long, Content string").repartition(3)
        saved = io.Saved(spark)
        new = saved(cat.entries(spark.createDataFrame(entries, "insert_seq long, template string")))
        kept = cat.kept(frame, new, "own", saved)
        want, out = in_order(lines, entries)
        assert {x["insert_seq"] for x in kept.collect()} == want
        assert {x["row_nr"]: x["EventTemplate"] for x in cat.match(frame, kept, "own").collect()} == {i: out.get(i) for i in range(len(lines))}


def test_catalogue_in_slices(spark, monkeypatch):
    rows = [(f"w{i} <*> end", i) for i in range(30)] + [("w3 exact end", 40), ("<*> <*> end", 50)]
    entries = cat.entries(spark.createDataFrame(rows, "template string, insert_seq long"))
    lines = spark.createDataFrame([(i, f"w{i} v{i} end") for i in range(40)] + [(99, "w3 exact end")], LOG)
    want = {r["row_nr"]: tuple(r)[2:4] for r in cat.match(lines, entries).collect()}
    monkeypatch.setattr(cat, "SLICE", 7)
    assert {r["row_nr"]: tuple(r)[2:4] for r in cat.match(lines, entries).collect()} == want
    assert want[3] == ("w3 <*> end", ["v3"]) and want[35][0] == "<*> <*> end" and want[99] == ("w3 exact end", [])


def test_both_dialects_agree_beyond_ascii(spark):
    rows = [("user <*> in", None), ("n <*>", [r"\d+"]), ("é.<*> ¿ok?", None), ("tab <*>", None)]
    entries = cat.entries(spark.createDataFrame(rows, "template string, slot_regexes array<string>"))
    texts = ["user a b in", "user ab in", "n ٣٤", "n 34", "n x", "é.7 ¿ok?", "é.　 ¿ok?", "tab a\x1cb", "tab a\x85b", "tab a\x0bb", "tab a b"]
    lines = spark.createDataFrame(list(enumerate(texts)), LOG)
    joined = {r[0]: r[1] for r in cat.match_by_join(lines, entries).collect()}
    assert joined == {r["row_nr"]: r["EventTemplate"] for r in cat.match(lines, entries).collect() if r["EventTemplate"]}
    assert {texts[i] for i in joined} == {"user ab in", "n ٣٤", "n 34", "é.7 ¿ok?", "tab a\x1cb"}


def test_long_path(spark):
    long = "/a" * 20_000
    df = spark.createDataFrame([(f"open {long} now",), (f"open {long}/ now",), ("x" + "<*>." * 30_000 + "<*>",)], "c string")
    got = [r[0] for r in df.select(text.correct(F.col("c"))).collect()]
    assert got == ["open <*> now", f"open {long}/ now", "<*>"]


def test_prompts():
    seen = []
    proposer = propose.prompted(lambda p: seen.append(p) or ("a <OID>", 3, 1), "Lines:\n{}\nEnd")
    assert proposer([["a 2", "a 1"]]) == [("a <OID>", 3, 1)] and seen == ["Lines:\na 1\na 2\nEnd"]
    assert set(propose.PROMPTS) == {"default", "no_example", "simple"} and all(p.count("{}") == 1 for p in propose.PROMPTS.values())
    assert not Options(prompt="simple").infer_slot_regexes and Options().infer_slot_regexes


def test_pruned_partitions_are_not_split(spark):
    rows = [f"{h} u{i} v{i % 7} w{i % 3}" for i in range(90) for h in ("big",)] + [f"rare a{i} b{i} c{i}" for i in range(5)] + ["only three words"]
    lines = partition.tokenise(spark.createDataFrame(list(enumerate(rows)), LOG))
    vec = partition.vectors(lines)
    got = partition.leaf_summary(partition.leaves(vec, file_support=0.02, partition_support=0.08)).collect()
    kinds = Counter((r["outlier"], r["token_len"], r["s2_value"], r["s3_side"] is not None) for r in got)
    assert kinds["S1", 3, None, False] == 1 and kinds["S2", 4, "rare", False] == 1
    assert all(r["s2_value"] == "big" or r["outlier"] for r in got)
    assert sum(r["n"] for r in got) == len(rows)
    for r in got:
        if r["s3_side"]:
            assert (r["outlier"] == "S3") == (r["n"] / 96 < 0.02 or r["n"] / 90 < 0.08)
    order = {r["leaf_ord"]: r for r in partition.in_order(partition.leaf_summary(partition.leaves(vec, file_support=0.02, partition_support=0.08))).collect()}
    assert [order[i]["outlier"] is not None for i in range(len(order))] == sorted(order[i]["outlier"] is not None for i in range(len(order)))


def test_event_ids_stay_over_batches(spark, tmp_path):
    for i, word in enumerate(("zebra", "apple")):
        spark.createDataFrame([(100 * i + k, 100 * i + k, f"{w} number {k} seen") for k in range(5) for w in {word, "zebra"}], "row_nr long, LineId long, Content string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    frame = spark.readStream.schema("row_nr long, LineId long, Content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    streams.discover_stream(frame, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/result"))
    assert got.select("v").distinct().count() == 2
    assert {tuple(r) for r in got.select("EventId", "EventTemplate").distinct().collect()} == {("E1", "zebra number <*> seen"), ("E2", "apple number <*> seen")}
    entries = [spark.read.parquet(str(tmp_path / f"out/entries/v={n}")).select("insert_seq", "template", "match_frequency").collect() for n in range(2)]
    assert [set(map(tuple, e)) for e in entries] == [{(0, "zebra number <*> seen", 5)}, {(1, "apple number <*> seen", 5), (0, None, 5)}]
    state = streams.State(spark, str(tmp_path / "out")).catalogue()
    assert {tuple(r) for r in state.select("template", "match_frequency").collect()} == {("zebra number <*> seen", 10), ("apple number <*> seen", 5)}


def test_row_index_keeps_every_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    n = docs.count()
    for got in (io.row_index(docs, F.col("doc_id")), io.row_index(docs)):
        assert got.columns == [*docs.columns, "row_nr"]
        assert got.agg(F.count_distinct("row_nr"), F.min("row_nr"), F.max("row_nr")).first()[:] == (n, 0, n - 1)
    assert io.row_index(docs, F.col("doc_id")).join(docs.select("doc_id"), "doc_id").filter("row_nr <> doc_id").count() == 0
    assert io.row_index(spark.range(0), F.col("id")).count() == 0


def test_custom_column_and_missing_row_numbers(spark):
    found = discover(views.logs(spark, SF).select(F.col("Content").alias("msg")), Options(content_col="msg"))
    assert found.result.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert found.result.filter("EventTemplate is null").count() == 0
