"""One summary row per dataset, failures included."""

from loglattice.options import Options
from loglattice.plans import views
from loglattice.plans.datasets import run_all
from loglattice.sources import io

SF = "/root/testdata/sf0.001"


def test_failures_are_rows(spark, tmp_path):
    logs = lambda: views.logs(spark, SF).select("row_nr", "LineId", "Content")
    truth = lambda: views.logs(spark, SF).select("LineId", "EventTemplate")
    got = {r["dataset"]: r for r in run_all(spark, {"bad": (lambda: 1 / 0, None), "events": (logs, truth), "half": (logs, lambda: 1 / 0)}, str(tmp_path), lambda n, d: Options(chunk_size=5000)).collect()}
    assert got["bad"]["error"].startswith("pipeline:") and got["bad"]["matched"] is None
    assert got["half"]["error"].startswith("eval:") and got["half"]["matched"] > 0
    e = got["events"]
    assert e["error"] is None and e["GA"] == e["PA"] == e["template_f1"] == 1.0 and e["noise"] == 0 and e["chunk_size"] == 5000 and e["total_time"] > 0
    assert io.read_csv(spark, str(tmp_path / "summary")).count() == 3
    assert io.read_parsed(spark, str(tmp_path / "events")).count() == e["matched"]
