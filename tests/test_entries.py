"""What the findings of the first review asked for."""

from loglattice.operators import catalogue as cat
from loglattice.options import Options
from loglattice.plans.discover import discover


def test_proposer_sees_random_lines_and_slots_all(spark):
    logs = spark.createDataFrame([(i, f"job number {'a' if i >= 40 else ''}{100 + i} is done") for i in range(50)], "row_nr long, Content string")

    def proposer(lists):
        assert all(len(s) <= 3 for s in lists)
        return ["job number <SID> is done" for _ in lists]

    found = discover(logs, Options(sample_n=3, repool_passes=0, singleton_fallback=False), proposer)
    assert [r["slot_regexes"] for r in found.catalogue.collect()] == [["[0-9a-fA-F]+"]]
    assert found.stats.first()["noise"] == 0


def test_one_template_with_two_regexes_keeps_both(spark):
    rows = [(i, f"port {i} open", 0) for i in range(4)] + [(10 + i, f"port x{i} open", 1) for i in range(4)]
    logs = spark.createDataFrame(rows, "row_nr long, Content string, chunk_id long")
    found = discover(logs, Options(repool_passes=0, singleton_fallback=False), lambda lists: ["port <SID> open"] * len(lists))
    assert {tuple(r["slot_regexes"]) for r in found.catalogue.collect()} == {(r"\d+",), (r"\S+",)}
    assert {r["EventTemplate"] for r in found.result.collect()} == {"port <*> open"}


def test_single_lines_are_proposed_and_known(spark):
    logs = spark.createDataFrame([(0, "alpha  beta 1 x"), (1, "gamma delta y")], "row_nr long, Content string")
    asked = lambda lists: [("alpha  beta <OBA> x" if s[0].startswith("alpha") else "gamma <OID> y") if len(s) == 1 else None for s in lists]
    seed = cat.entries(spark.createDataFrame([("no such line",)], "template string"))
    found = discover(logs, Options(repool_passes=-1, template_correction=False), asked, seed)
    assert {(r["EventTemplate"], *r["ParameterList"], *r["SlotTypes"]) for r in found.result.collect()} == {("alpha  beta <*> x", "1", "OBA"), ("gamma <*> y", "delta", "OID")}
    assert {r["template"] for r in found.catalogue.collect()} == {"no such line", "alpha  beta <*> x", "gamma <*> y"}
