"""Discovery and evaluation of several datasets, one summary row each; a failure is told in its row and the others go on."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import evaluate, propose
from loglattice.options import Options
from loglattice.plans.discover import discover
from loglattice.sources import io

SUMMARY = (
    "dataset string, chunk_size long, out_path string, matched long, noise long, llm_calls long, input_tokens long, output_tokens long, total_time double, "
    "GA double, FGA double, PA double, n_gt_templates long, n_pred_templates long, exact_template_matches long, template_precision double, "
    "template_recall double, template_f1 double, error string"
)
_NAMES = [c.split()[0] for c in SUMMARY.split(", ")]


def run_all(
    spark: SparkSession,
    datasets: dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame] | None]],
    folder: str,
    options: Callable[[str, DataFrame], Options] = lambda name, logs: Options(),
    proposer: propose.Proposer | None = None,
    kind: str = "csv",
) -> DataFrame:
    """The summary of ``datasets`` (name: readers of its logs and, if there is one, its ground truth).

    ``folder`` gets each dataset's result with the options that it was made with and, after each one, the summary so far.
    """
    done: list[dict] = []
    for name, (logs, truth) in datasets.items():
        row: dict = dict.fromkeys(_NAMES) | {"dataset": name}
        step, start, found = "pipeline", time.monotonic(), None
        try:
            lines = logs()
            chosen = options(name, lines)
            found = discover(lines, chosen, proposer)
            path = f"{folder}/{name}"
            io.write_result(found.result, path, kind)
            io.write_config(spark, chosen, f"{folder}/{name}-options")
            row |= {"chunk_size": chosen.chunk_size, "out_path": path} | found.stats.first().asDict()
            row["total_time"] = time.monotonic() - start
            if truth is not None:
                step = "eval"
                metrics = evaluate.summary(truth().withColumn("dataset", F.lit(name)), found.result.withColumn("dataset", F.lit(name))).first()
                row |= {k: v for k, v in (metrics.asDict() if metrics else {}).items() if k in _NAMES}
        except Exception as problem:  # whatever fails, the other datasets go on
            row["error"] = f"{step}: {problem}"
        finally:
            if found is not None:
                found.tables.clear()
        done.append(row)
        io.write_summary(summary(spark, done), f"{folder}/summary")
    return summary(spark, done)


def summary(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n in _NAMES) for r in rows], SUMMARY)
