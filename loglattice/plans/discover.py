"""Discover templates: match, partition what is left, propose, reconcile in order, repool, and finish single lines.

Chunks are worked on in waves of 1, 2, 4, … chunks, so the catalogue grows from wave to wave and a log of n chunks takes about
log2(n) waves.  Lines are matched first; only what no entry matches is partitioned, chunk by chunk, and leaves of several chunks of a
wave that have the same keys are one leaf: the proposer is asked once for it.

Lines are never shuffled: a line finds its leaf by small tables of keys, and proposals come from distinct token vectors and a few
lines sampled from each leaf.  What is decided (answers, kept entries, matches) is written to the shared folder, answers slice by slice, so a proposer isn't
asked again when an executor is lost; with a folder for ``Options.answers`` not even by a run that is started anew.  With a folder for ``Options.resume`` a run
whose driver was lost goes on from its last finished wave: a manifest names the lines, the catalogue and each wave's matches.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.operators import catalogue as cat
from loglattice.operators import partition, propose, slots
from loglattice.options import Options
from loglattice.sources.io import Manifest, Saved, joinable, remove, row_index, spread

#: Each reconcile numbers its entries from a multiple of this.
_STEP = 1 << 40
_KEYS = ["token_len", "s2_pos", "s2_value", "s3_side", "s3_value"]


@dataclass(frozen=True)
class Discovery:
    catalogue: DataFrame
    stats: DataFrame
    matched: DataFrame  # as result, with row_nr instead of event ids
    first_new: int  # entries of the catalogue with this insert_seq or more are new; those of a seed are numbered from 0
    tables: Saved  # what these read, in the shared folder; ``tables.clear()`` when they are done with

    @cached_property
    def result(self) -> DataFrame:
        return cat.result(self.matched, cat.event_ids(self.matched, saved=self.tables))


@dataclass
class _Run:
    options: Options
    proposer: propose.Proposer | None
    saved: Saved
    answers: str
    known: DataFrame | None = None
    next_seq: int = 0
    parts: list[DataFrame] = field(default_factory=list)  # written tables; their lines with a template are done
    asked: list[int] = field(default_factory=lambda: [0, 0, 0])  # calls, tokens sent, tokens back


def _leaves(run: _Run, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Token vectors with their leaf, and the leaves in their order (insert_seq)."""
    o = run.options
    vec = run.saved(partition.vectors(lines))
    found = run.saved(partition.leaves(vec, o.goodness, o.lower_bound, False, o.file_support, o.partition_support, run.saved))
    one = partition.leaf_summary(found).groupBy(*_KEYS).agg(
        F.min("chunk_id").alias("chunk_id"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("outlier").alias("outlier")
    )
    order = partition.in_order(one, run.saved)
    return found, run.saved(order.select(*_KEYS, "n", F.col("first").alias("start"), (F.col("leaf_ord") + run.next_seq).alias("insert_seq")))


def _sampled(run: _Run, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each leaf's first line, its sampled lines (``samples``) and those that a proposer sees (``few``).

    ``lines`` with their leaf's insert_seq (own) and its first line (start); ``sizes``: the lines (n) of each leaf.  Lines are drawn at random, not their token vectors.
    """
    o = run.options
    picked = propose.drawn(lines.select("row_nr", "Content", "own"), "own", sizes, max(o.sample_n, o.infer_n)).select("row_nr", "Content", "own", "rank")
    begin = lines.filter("row_nr = start").select("row_nr", "Content", "own", F.lit(None).cast("int").alias("rank"))
    got = picked.unionByName(begin).withColumnRenamed("own", "insert_seq")
    return got.groupBy("insert_seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.col("Content")))).alias("samples"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= o.sample_n, text.truncated(F.col("Content"), o.max_words)))).alias("few"),
        F.array_min(F.collect_list(F.when(F.col("rank").isNull(), F.col("Content")))).alias("line"),
    )


def _entries(run: _Run, asked: DataFrame, infer: bool) -> DataFrame:
    """Catalogue entries of raw proposals, written; counts calls and tokens."""
    done = asked.withColumns({"template": text.finish(F.col("raw_template"), run.options.template_correction), "slot_types": text.slot_types(F.col("raw_template"))})
    done = slots.infer(done) if infer else done.withColumn("slot_regexes", F.lit(None).cast("array<string>"))
    tokens = [c for c in ("fresh", "input_tokens", "output_tokens") if c in done.columns]
    out = run.saved(cat.entries(done.select("insert_seq", "template", "slot_types", "slot_regexes", *tokens)))
    if tokens:
        run.asked = [a + b for a, b in zip(run.asked, propose.call_totals(out).first(), strict=True)]
    return out.drop(*tokens)


def _reconcile(run: _Run, lines: DataFrame, new: DataFrame) -> DataFrame:
    """Match lines (with their own leaf's insert_seq) with ``new`` entries, leaf by leaf in order; what is left.

    A line takes the best of the entries kept from earlier leaves, else its own leaf's; an entry is kept if a line takes it as its own.
    """
    kept = run.saved(cat.kept(lines, new, "own", run.saved))
    run.next_seq += _STEP
    done = run.saved(cat.match(lines, kept, "own", keep_entry=True, saved=run.saved).drop("own"))
    run.parts.append(done)
    run.known = kept if run.known is None else run.saved(run.known.select(*kept.columns).unionByName(kept))
    return done.filter("EventTemplate is null").select(*[c for c in done.columns if c not in dict(cat.FOUND)])


def _known(run: _Run, lines: DataFrame) -> DataFrame:
    """Match lines with what is known; what is left."""
    if run.known is None:
        return lines
    done = run.saved(cat.match(lines, run.known, keep_entry=True, saved=run.saved))
    run.parts.append(done)
    return done.filter("EventTemplate is null").select(*lines.columns)


def _round(run: _Run, lines: DataFrame) -> DataFrame:
    """Propose a template for each leaf of ``lines`` and match them; what is left."""
    o, tokens = run.options, partition.tokenise(lines)
    found, leaves = _leaves(run, tokens)
    named = joinable(leaves.select(*_KEYS, F.col("insert_seq").alias("own"), "start"))
    keyed = propose.null_safe_join(partition.assignment(tokens, found, run.saved), named, _KEYS)
    keyed = run.saved(keyed.select(*lines.columns, "own", "start"))
    grouped = _sampled(run, keyed, leaves.select(F.col("insert_seq").alias("own"), "n"))
    if run.proposer is None:
        grouped = run.saved(grouped)
        own = propose.null_safe_join(found.drop("n", "first"), leaves, _KEYS)
        asked = grouped.join(propose.structural(own.select("insert_seq", "words"), grouped.select("insert_seq", "line"), ["insert_seq"]), "insert_seq")
    else:
        asked = propose.ask(grouped, run.proposer, o.max_concurrent, "few", o.timeout, run.answers, run.saved)
    new = _entries(run, asked, o.infer_slot_regexes)
    return _reconcile(run, keyed.drop("start"), new)


def _singles(run: _Run, lines: DataFrame) -> DataFrame:
    """Propose a template for each distinct text of ``lines`` alone and match them, first lines first; what is left."""
    texts = lines.groupBy("Content").agg(F.min("row_nr").alias("first"))
    texts = row_index(texts, F.col("first"), saved=run.saved).select("Content", (F.col("row_nr") + run.next_seq).alias("insert_seq"))
    if run.proposer is None:
        asked = texts.withColumn("raw_template", F.col("Content"))
    else:
        alone = texts.select("insert_seq", F.array("Content").alias("samples"))
        asked = propose.ask(alone, run.proposer, run.options.max_concurrent, "samples", run.options.timeout, run.answers, run.saved)
    new = _entries(run, asked, False)
    return _reconcile(run, lines.join(texts.withColumnRenamed("insert_seq", "own"), "Content").select(*lines.columns, "own"), new)


def _waves(low: int | None, high: int | None, size: int = 1):
    while low is not None and low <= high:
        yield low, min(low + size - 1, high), size
        low, size = low + size, 2 * size


def _wave(run: _Run, left: DataFrame) -> DataFrame | None:
    """Match, propose, repool and finish single lines; what is left then, None if nothing is."""
    o = run.options
    for step in range(o.repool_passes + 1):
        if step and left.isEmpty():
            return None
        left = _known(run, left)
        if left.isEmpty():
            return None
        left = _round(run, left)
    if o.singleton_fallback:
        if left.isEmpty():
            return None
        left = _known(run, left)
        if left.isEmpty():
            return None
        left = _singles(run, left)
    return None if left.isEmpty() else left


def _prepared(run: _Run, logs: DataFrame, seed: DataFrame | None) -> DataFrame:
    """The lines with row_nr and chunk_id; takes up ``seed``."""
    o = run.options
    base = logs.withColumnRenamed(o.content_col, "Content")
    base = row_index(base.select(*[c for c in ("row_nr", "LineId", "Content", "chunk_id") if c in base.columns]), saved=run.saved)
    chunk = F.col("chunk_id") if "chunk_id" in base.columns else F.floor(F.col("row_nr") / o.chunk_size).cast("long")
    lines = base.select(*[c for c in ("row_nr", "LineId", "Content") if c in base.columns], chunk.alias("chunk_id"))
    if seed is not None:
        numbered = row_index(cat.distinct(seed), *cat.insertion(), saved=run.saved)
        run.known = run.saved(numbered.drop("insert_seq").withColumnRenamed("row_nr", "insert_seq"))
        run.next_seq = _STEP
    return run.saved(lines) if o.resume else lines


def _state(run: _Run, lines: DataFrame, noise: list[DataFrame | None], wave: tuple, seconds: float) -> dict:
    path = run.saved.path
    return {
        "options": _told(run.options), "lines": path(lines), "known": None if run.known is None else path(run.known), "parts": [path(p) for p in run.parts], "noise": [None if n is None else path(n) for n in noise],
        "next_seq": run.next_seq, "asked": run.asked, "wave": list(wave), "seconds": seconds,
    }


def _told(options: Options) -> str:
    return repr({k: v for k, v in asdict(options).items() if k not in ("resume", "answers", "max_concurrent", "timeout")})


def _found(run: _Run, lines: DataFrame, nulls: bool, rest: DataFrame | None, adopted: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Every line with what it matched, and the written tables that hold it.

    The waves' tables are one scan, not a branch of a union each, and aren't written again unless they are an earlier run's (``adopted``).
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in cat.FOUND]
    others = [lines.filter("Content is null")] if nulls or not run.parts else []
    others += [] if rest is None else [rest.select(*lines.columns)]
    tables, found = list(run.parts), None
    if tables:
        found = run.saved.together(tables).filter("EventTemplate is not null").drop("chunk_id")
    for some in others:
        tables.append(run.saved(some.select("*", *none).drop("chunk_id")))
        found = tables[-1] if found is None else found.unionByName(tables[-1])
    if adopted:
        found = run.saved(found)
        tables = [found]
    return found, tables


def discover(
    logs: DataFrame, options: Options = Options(), proposer: propose.Proposer | None = None, seed: DataFrame | None = None, model: Callable[[str], object] | None = None  # noqa: B008
) -> Discovery:
    """Templates of ``logs`` (the text column, maybe row_nr, LineId and chunk_id), with ``seed`` as what is known before.

    ``model`` takes a prompt (``Options.prompt`` with the lines) and gives an answer; a ``proposer`` takes the lines themselves.  Without either the structural one is used.  Null texts are in the result, without a template and uncounted.
    """
    start = time.monotonic()
    if model is not None:
        proposer = propose.prompted(model, options.prompt)
    spark = logs.sparkSession
    manifest = Manifest(spark, options.resume) if options.resume else None
    saved = Saved(spark, options.resume)
    run = _Run(options, proposer, saved, options.answers or f"{options.resume or saved.folder}/answers")
    noise, wave, before, last = [], None, 0.0, manifest and manifest.last()
    if last:
        step, state = last
        if state["options"] != _told(options):
            raise ValueError(f"the run in {options.resume} has other options: {state['options']}")
        lines, run.parts, noise = saved.adopt(state["lines"]), list(map(saved.adopt, state["parts"])), [None if n is None else saved.adopt(n) for n in state["noise"]]
        run.known = state["known"] and saved.adopt(state["known"])
        run.next_seq, run.asked, wave, before = state["next_seq"], state["asked"], state["wave"], state["seconds"]
    else:
        step, lines = 0, _prepared(run, logs, seed)
    by_number, nulls = "chunk_id" not in logs.columns, True
    ready = [t for _, t in saved.paths.values()]
    whole = lines.filter("Content is not null")
    if wave is None:
        number = F.when(F.col("Content").isNotNull(), F.col("chunk_id"))
        low, high, nulls = lines.agg(F.min(number), F.max(number), F.count_if(F.col("Content").isNull()) > 0).first()
        wave = (low, high, 1)
        if manifest:
            manifest.write(step, _state(run, lines, noise, wave, time.monotonic() - start))
    for low, high, size in _waves(*wave):
        # rows, not chunk numbers, are filtered where they can be: files outside a wave's rows aren't read
        bound = F.col("row_nr").between(low * options.chunk_size, (high + 1) * options.chunk_size - 1) if by_number else F.col("chunk_id").between(low, high)
        some = spread(whole.filter(bound))
        left = _wave(run, saved(some) if run.known is None else some)  # without known entries they are read several times
        noise.append(saved(left) if manifest and left is not None else left)
        if manifest:
            step += 1
            manifest.write(step, _state(run, lines, noise, (high + 1, wave[1], 2 * size), before + time.monotonic() - start))
        saved.clear(*ready, *run.parts, *(n for n in noise if n is not None), *([] if run.known is None else [run.known]))
    rest = None
    for left in (n for n in noise if n is not None):
        rest = left if rest is None else rest.unionByName(left)
    if rest is not None and run.known is not None and len(noise) > 1:
        rest = _known(run, rest)
    found, tables = _found(run, lines, nulls, rest, bool(last))
    known = run.known if run.known is not None else cat.entries(spark.createDataFrame([], "template string"))
    known = saved(known) if last else known  # not in the folder of the run that was stopped
    totals = dict(zip(("llm_calls", "input_tokens", "output_tokens"), run.asked, strict=True))
    stats = cat.run_stats(found).withColumns({k: F.lit(v).cast("long") for k, v in totals.items()}).withColumn("total_time", F.lit(before + time.monotonic() - start))
    if not options.answers:
        remove(spark, run.answers)
    run.saved.clear(*tables, known)
    if manifest:
        manifest.end(saved.folder)
    return Discovery(cat.counted(known, found), stats, found, _STEP, run.saved)
