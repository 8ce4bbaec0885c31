"""Templates on streams: apply a catalogue, fixed or growing, or discover with a catalogue that grows by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglattice.operators import catalogue as cat
from loglattice.options import Options
from loglattice.plans.discover import discover
from loglattice.sources import io

#: Batches after which the state is written as a whole again.
COMPACT = 16


def apply_catalogue(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stateless: works on batch and streaming frames alike."""
    return cat.match(lines, catalogue)


class State:
    """The catalogue and event ids of a discovery stream, in ``folder``.

    ``entries/v=N`` has what batch N added: its new entries and, for older ones that it matched, a row of insert_seq and how many lines; ``ids/v=N`` its new templates.
    ``base/v=N`` and ``base_ids/v=N`` are the whole after batch N, written each COMPACT batches.  The base before the last and all since stay, so a batch can be replayed
    and a reader isn't disturbed by one compaction.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _steps(self, kind: str) -> list[int]:
        return sorted(int(name[2:]) for name in io.complete(self.spark, f"{self.folder}/{kind}"))

    def _read(self, base: str, kind: str, before: int | None) -> tuple[DataFrame | None, int]:
        """What was there before a batch (None: now), and the number of batches since its base."""
        early = lambda k: [n for n in self._steps(k) if before is None or n < before]
        whole = early(base)[-1:]
        since = [n for n in early(kind) if not whole or n > whole[0]]
        paths = [f"{self.folder}/{base}/v={n}" for n in whole] + [f"{self.folder}/{kind}/v={n}" for n in since]
        return (self.spark.read.parquet(*paths) if paths else None), len(since)

    def ids(self, before: int | None = None) -> DataFrame | None:
        return self._read("base_ids", "ids", before)[0]

    def catalogue(self, before: int | None = None) -> DataFrame | None:
        rows, _ = self._read("base", "entries", before)
        if rows is None:
            return None
        counts = rows.groupBy("insert_seq").agg(F.sum("match_frequency").alias("match_frequency"))
        return rows.filter("template is not null").drop("match_frequency").join(counts, "insert_seq").select(*rows.columns)

    def add(self, number: int, catalogue: DataFrame, matched: DataFrame, known: int, first_new: int, saved: io.Saved) -> None:
        """Write what a batch added to ``known`` entries, which have the insert_seq 0, 1, …; new ones have first_new or more."""
        more = matched.filter("entry is not null").groupBy(F.col("entry").alias("insert_seq")).agg(F.count("*").alias("_more"))
        new = io.row_index(catalogue.filter(F.col("insert_seq") >= first_new), F.col("insert_seq"), saved=saved)
        new = new.join(more, "insert_seq", "left").withColumns({"insert_seq": F.col("row_nr") + known, "match_frequency": F.coalesce("_more", F.lit(0).cast("long"))})
        old = more.filter(F.col("insert_seq") < first_new).withColumnRenamed("_more", "match_frequency")
        both = new.select(*catalogue.columns).unionByName(old, allowMissingColumns=True)
        both.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/entries/v={number}")

    def compact(self, number: int) -> None:
        if self._read("base", "entries", number + 1)[1] < COMPACT:
            return
        last = self._steps("base")[-1:]
        self.ids(number + 1).write.mode("overwrite").parquet(f"{self.folder}/base_ids/v={number}")
        self.catalogue(number + 1).write.mode("overwrite").parquet(f"{self.folder}/base/v={number}")
        for kind, past in (("base", -1), ("base_ids", -1), ("entries", 0), ("ids", 0)):
            for n in self._steps(kind) if last else []:
                if n <= last[0] + past:
                    io.remove(self.spark, f"{self.folder}/{kind}/v={n}")


def discover_stream(
    lines: DataFrame, folder: str, checkpoint: str, options: Options = Options(), proposer=None, trigger: dict | None = None  # noqa: B008
) -> StreamingQuery:
    """One micro-batch is one run of ``discover`` on what is known so far.

    The state is that of ``State``, ``folder/result/v=N`` batch N's lines.  A template keeps its event id in all later batches.  A
    replayed batch reads the state before N and overwrites its own output, so results stay exactly-once.  ``trigger``: arguments of the
    writer's trigger (default: what is there now).
    """
    spark = lines.sparkSession
    state = State(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        seed, ids = state.catalogue(number), state.ids(number)
        known = 0 if seed is None else seed.count()
        found = discover(batch, options, proposer, seed)
        every = cat.event_ids(found.matched, ids, found.tables)
        new = every if ids is None else every.join(ids, "EventTemplate", "left_anti")
        new.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ids/v={number}")
        cat.result(found.matched, state.ids(number + 1)).write.mode("overwrite").parquet(f"{folder}/result/v={number}")
        state.add(number, found.catalogue, found.matched, known, 0 if seed is None else found.first_new, found.tables)
        found.tables.clear()
        state.compact(number)

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def apply_stream(lines: DataFrame, folder: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Match each micro-batch with the newest catalogue of a discovery stream in ``folder``; ``out/v=N`` has batch N's result with event ids.

    Lines need LineId or row_nr.  A catalogue that grows is seen by the next batch; a replayed batch overwrites its own output.
    """
    spark = lines.sparkSession
    state = State(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        catalogue, ids = state.catalogue(), state.ids()
        catalogue = cat.entries(spark.createDataFrame([], "template string")) if catalogue is None else catalogue
        ids = spark.createDataFrame([], "EventTemplate string, EventId string") if ids is None else ids
        saved = io.Saved(spark)
        cat.result(cat.match(batch, catalogue, saved=saved), ids).write.mode("overwrite").parquet(f"{out}/v={number}")
        saved.clear()

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
