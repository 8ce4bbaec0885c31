"""Readers and writers of logs, ground truth, results and summaries."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.options import Options
from loglattice.sources.records import read_csv

TRUTH = "LineId long, Content string, EventTemplate string"
RESULT = "LineId long, EventId string, Content string, EventTemplate string, ParameterList string, SlotTypes string"


def read_truth(spark: SparkSession, path: str, correction: bool = False) -> DataFrame:
    out = read_csv(spark, path, TRUTH)
    return corrected(out) if correction else out


def corrected(df: DataFrame, column: str = "EventTemplate") -> DataFrame:
    """Correct a template column: each distinct template once, then joined back."""
    name = free_name(df, "corrected")
    once = df.select(column).distinct().withColumn(name, text.correct(F.col(column)))
    return df.join(once, column, "left").withColumn(column, F.col(name)).select(*df.columns)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RESULT)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where none is named, one machine (a local master) takes a temporary folder; a cluster is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _filesystem(spark, path)
    fs.delete(p, True)


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` that hold a completely written table; one listing."""
    p, fs = _filesystem(spark, f"{path}/*/_SUCCESS")
    return sorted(s.getPath().getParent().getName() for s in fs.globStatus(p) or [])


def complete_table(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table that was completely written once at least."""
    p, fs = _filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


class Saved:
    """Tables written to the shared folder to cut lineage; ``clear`` removes all but those named."""

    def __init__(self, spark: SparkSession, within: str | None = None) -> None:
        self.spark, self.folder, self.paths, self.count = spark, f"{within or shared_folder(spark)}/run-{uuid.uuid4().hex}", {}, 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of equal columns that were written here, all rows, in one scan that deals their files to tasks by size."""
        return self.spark.read.schema(tables[0].schema).parquet(*map(self.path, tables))

    def path(self, df: DataFrame) -> str:
        return self.paths[id(df)][0]

    def adopt(self, path: str) -> DataFrame:
        """A table that an earlier run wrote, as if it were written here."""
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def clear(self, *keep: DataFrame) -> None:
        for i, (path, _) in self.paths.items():
            if i not in map(id, keep):
                remove(self.spark, path)
        self.paths = {i: x for i, x in self.paths.items() if i in map(id, keep)}
        if not self.paths:
            remove(self.spark, self.folder)


class Manifest:
    """What a run has finished: one small JSON row per step in ``folder``/state, of which a reader takes the last complete one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def write(self, step: int, state: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(state),)], "state string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.folder}/state/v={step}")

    def last(self) -> tuple[int, dict] | None:
        steps = [int(name[2:]) for name in complete(self.spark, f"{self.folder}/state")]
        if not steps:
            return None
        return max(steps), json.loads(self.spark.read.text(f"{self.folder}/state/v={max(steps)}").first()[0])

    def end(self, keep: str) -> None:
        """Remove all that is in the folder but ``keep``."""
        p, fs = _filesystem(self.spark, f"{self.folder}/*")
        for found in fs.globStatus(p) or []:
            if found.getPath().getName() != keep.rsplit("/", 1)[1]:
                fs.delete(found.getPath(), True)


def small(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether a derived table has at most ``rows`` rows, counted on the cluster."""
    return df.limit(rows + 1).count() <= rows


def joinable(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if its counted size allows it, else left to a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` (with row_nr), rows as they are read, dealt evenly to all cores.

    The number of parts doesn't tell whether they hold rows: a row group of a file is read by one task, in however many parts the file is cut, and a range
    of rows lies in few row groups.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), "row_nr")


def row_index(df: DataFrame, *order: Column, saved: Saved | None = None) -> DataFrame:
    """row_nr 0..n-1, by ``order`` or in the table's own order, without pulling all rows into one task.

    The sorted table is written once with each row's partition and place in it; sizes and numbers both come from what
    was written.  The offsets are one row per partition.
    """
    if "row_nr" in df.columns:
        return df
    part, nth = (free_name(df, n) for n in ("part", "nth"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    marked = dealt.withColumn(nth, F.monotonically_increasing_id())
    marked = marked.withColumns({part: F.shiftright(nth, 33), nth: F.col(nth).bitwiseAND(F.lit((1 << 33) - 1))})
    marked = (saved or Saved(df.sparkSession))(marked)
    sizes = marked.groupBy(part).agg(F.count("*").alias("row_nr"))
    rows, total = [], 0
    for p, n in sorted(map(tuple, sizes.collect())):
        rows.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows, f"{part} long, row_nr long")
    out = marked.join(F.broadcast(offsets), part)
    return out.select(*df.columns, (F.col("row_nr") + F.col(nth)).alias("row_nr"))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def write_result(result: DataFrame, path: str, kind: str = "parquet") -> None:
    """Sorted by LineId; in CSV list columns are text."""
    out = result.orderBy("LineId")
    if kind == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        out.withColumns({c: text.listed(F.col(c)) for c in ("ParameterList", "SlotTypes")}).write.mode("overwrite").options(header=True, quote=chr(34), escape=chr(34)).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").options(header=True, quote=chr(34), escape=chr(34)).csv(path)


def write_config(spark: SparkSession, options: Options, path: str) -> None:
    known = {k: v for k, v in asdict(options).items() if v is not None}
    spark.createDataFrame([known]).write.mode("overwrite").json(path)
