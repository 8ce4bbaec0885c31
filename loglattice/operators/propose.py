"""Samples, prompts and proposals of templates for leaves."""

from __future__ import annotations

import os
import pickle
import select
import signal
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.sources.io import Saved, complete_table, joinable

#: Takes lists of sample lines and returns for each a raw template, or (raw template, input tokens, output tokens).
#: It is called with one list at a time, in a process of its own; None or an exception means no answer.
Proposer = Callable[[list[list[str]]], list]
#: Prompt texts by name; ``{}`` is where the sample lines go.  The simple one asks for untyped slots.
PROMPTS = {
    "default": (
        "These log lines come from one statement of a program. Write its template: copy what is fixed, and put a tag where a value "
        "varies. Tags: <OID> an object's id, <LOI> a place, <OBN> an object's name, <TID> a type, <SID> a switch or number, <TDA> a time or date, "
        "<CRS> a resource, <OBA> an amount, <STC> a status code, <OTP> anything else.\n"
        "Example: 'Sent 17 bytes to node-3' and 'Sent 4 bytes to node-9' have the template 'Sent <OBA> bytes to <LOI>'.\n{}\nTemplate:"
    ),
    "no_example": (
        "These log lines come from one statement of a program. Write its template: copy what is fixed, and put one of the tags "
        "<OID>, <LOI>, <OBN>, <TID>, <SID>, <TDA>, <CRS>, <OBA>, <STC>, <OTP> where a value varies.\n{}\nTemplate:"
    ),
    "simple": "Write the template of these log lines, with <*> for each value that varies.\n{}\nTemplate:",
}


def sample(lines: DataFrame, keys: list[str], n: int, seed: int | None = None) -> DataFrame:
    """At most ``n`` lines per group without replacement: by a seeded hash of row_nr, or the first ones.

    The rank limit is applied before the shuffle, so a huge group ships ``n`` rows per task.
    """
    order = [F.col("row_nr")] if seed is None else [F.xxhash64(F.lit(seed), "row_nr"), F.col("row_nr")]
    return lines.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def _place(seed: int) -> Column:
    """A text that orders lines at random, the same on every run and in other engines: the md5 of seed and row_nr."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_nr").cast("string")).cast("binary"))


def drawn(lines: DataFrame, key: str, sizes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` lines of each ``key`` at random, without replacement, with their ``rank``: those whose place is smallest.

    ``sizes``: the number of lines (n) of each key.  A line is passed on only if its place is in the share of its key that is expected to hold 4 n
    + 40 lines, so tasks neither sort nor ship a large key's lines; a key that comes short by that (once in e^30 draws) is drawn again from all of
    its lines.
    """
    order = Window.partitionBy(key).orderBy("_place", "row_nr")
    sizes = sizes.select(key, F.col("n").alias("_size"))
    placed = lines.withColumn("_place", _place(seed)).join(joinable(sizes), key)
    share = F.conv(F.substring("_place", 1, 12), 16, 10).cast("double") / float(1 << 48)
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    some = top(placed.filter(share < (4 * n + 40) / F.col("_size")))
    got = sizes.join(some.groupBy(key).agg(F.max("rank").alias("_got")), key, "left")
    missing = [r[0] for r in got.filter(F.coalesce("_got", F.lit(0)) < F.least("_size", F.lit(n))).select(key).collect()]
    if missing:
        some = some.filter(~F.col(key).isin(missing)).unionByName(top(placed.filter(F.col(key).isin(missing))))
    return some.drop("_place", "_size")


def samples(lines: DataFrame, keys: list[str], n: int, seed: int | None = None, words: int = 0) -> DataFrame:
    """Each group's sample lines, sorted, as one array of at most ``n``."""
    line = text.truncated(F.col("Content"), words)
    return sample(lines, keys, n, seed).groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("samples"))


def prompts(grouped: DataFrame, template: str) -> DataFrame:
    return grouped.withColumn("prompt", F.replace(F.lit(template), F.lit("{}"), F.array_join("samples", "\n")))


def prompted(model: Callable[[str], object], prompt: str = "default") -> Proposer:
    """A proposer that sends one of PROMPTS (or a text of one's own with ``{}``) to ``model``: prompt in, answer out."""
    whole = PROMPTS.get(prompt, prompt)
    return lambda lists: [model(whole.replace("{}", "\n".join(sorted(s)))) for s in lists]


def structural(found: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """The offline proposer: tokens that are constant in a leaf stay, others become slots.

    ``found``: words of each leaf's token vectors; ``firsts``: each leaf's first ``line``, whose separators are kept.
    """
    at = found.select(*keys, F.posexplode("words").alias("pos", "token")).withColumn("h", F.xxhash64("token"))
    constant = at.groupBy(*keys, "pos").agg((F.min("h") == F.max("h")).alias("same"))
    flags = constant.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "same"))), lambda x: x["same"]).alias("flags"))
    parts = F.regexp_extract_all("line", F.lit(r"(?U)[\s=:,]+|[^\s=:,]+"), F.lit(0))
    lead = F.when(F.get("parts", F.lit(0)).rlike(r"(?U)^[\s=:,]"), 1).otherwise(0)
    kept = lambda i: F.get("flags", ((i - F.col("lead")) / 2).cast("int"))
    built = F.transform("parts", lambda p, i: F.when(p.rlike(r"(?U)^[\s=:,]") | kept(i), p).otherwise(text.SLOT))
    joined = null_safe_join(firsts, flags, keys, "left").withColumn("parts", parts).withColumn("lead", lead)
    return joined.select(*keys, F.array_join(built, "").alias("raw_template"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        test = left[k].eqNullSafe(r[f"_{k}"])
        on = test if on is None else on & test
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def _call(proposer: Proposer, lines: list[str], end: int) -> None:
    """In the child process: one call, its answer written to ``end``."""
    parent = os.getppid()

    def watch() -> None:  # no call outlives the task's process
        while os.getppid() == parent:
            time.sleep(0.5)
        os._exit(1)

    threading.Thread(target=watch, daemon=True).start()
    try:
        answer = proposer([lines])[0]
        raw, sent, back = answer if isinstance(answer, tuple) else (answer, 0, 0)
        said = pickle.dumps((raw if isinstance(raw, str) else None, int(sent or 0), int(back or 0)))
        while said:
            said = said[os.write(end, said) :]
    finally:
        os._exit(0)


def _answer(proposer: Proposer, lines: list[str], seconds: float) -> tuple[str | None, int, int]:
    """One call in a process of its own, which is ended after ``seconds``; no answer by then, or any error, is None."""
    out, end = os.pipe()
    child = os.fork()
    if not child:
        os.close(out)
        _call(proposer, lines, end)
    os.close(end)
    said, until = b"", time.monotonic() + seconds if seconds else None
    try:
        while True:
            left = None if until is None else until - time.monotonic()
            if left is not None and left <= 0 or not select.select([out], [], [], left)[0]:
                return None, 0, 0
            part = os.read(out, 65536)
            if not part:
                break
            said += part
    finally:
        os.close(out)
        os.kill(child, signal.SIGKILL)
        os.waitpid(child, 0)
    return pickle.loads(said) if said else (None, 0, 0)  # noqa: S301  written by the child


_ANSWER = "question string, raw_template string, failed boolean, input_tokens bigint, output_tokens bigint"
#: Leaves whose answers are appended to the store at once.
SLICE_LEAVES = 200


def ask(
    grouped: DataFrame, proposer: Proposer, max_concurrent: int, shown: str = "samples", seconds: float = 60.0, store: str | None = None, saved: Saved | None = None
) -> DataFrame:
    """Raw templates from a callable that sees the lines in ``shown``, leaf by leaf; at most ``max_concurrent`` calls are alive at a time.

    Answers are kept in the table ``store`` (a folder that driver and executors share) under a hash of the lines shown.  Leaves are asked for slice by slice, each
    appended when it is done, and what the store knows isn't asked again: not after a lost executor, nor when a run is started anew with
    the same store.  Leaves that show the same lines are asked for once.  A leaf without an answer in time falls back to its first line (and is asked for again by a later run);
    ``failed``, ``fresh`` (one leaf of each call made), input_tokens and output_tokens tell of each call.
    """
    spark = grouped.sparkSession
    saved = saved or Saved(spark)
    store = store or f"{saved.folder}/answers-{saved.count}"
    wanted = saved(grouped.withColumn("question", F.sha2(F.to_json(F.struct(F.col(shown).alias("q"))).cast("binary"), 256)))
    known = lambda: spark.read.schema(_ANSWER).parquet(store) if complete_table(spark, store) else spark.createDataFrame([], _ANSWER)
    new = wanted.select("question", F.col(shown).alias("lines")).dropDuplicates(["question"])
    new = saved(new.join(joinable(known().filter(~F.col("failed")).select("question")), "question", "left_anti"))
    count = new.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for question, lines in zip(pdf["question"], pdf["lines"], strict=True):
                raw, sent, back = _answer(proposer, list(lines), seconds)
                yield pd.DataFrame({"question": [question], "raw_template": [raw], "failed": [raw is None], "input_tokens": [sent], "output_tokens": [back]})

    parts = -(-count // SLICE_LEAVES)
    for part in range(parts):
        some = new.filter(F.pmod(F.crc32(F.col("question").cast("binary")), F.lit(parts)) == part) if parts > 1 else new
        some.repartition(max_concurrent).mapInPandas(run, _ANSWER).write.mode("append").parquet(store)
    # of several answers to one question (after a failure) the one that has a template
    told = known().groupBy("question").agg(F.min_by(F.struct("raw_template", "failed", "input_tokens", "output_tokens"), "failed").alias("a"))
    asked = new.select("question", F.lit(True).alias("fresh"))
    one = wanted.groupBy("question").agg(F.min(F.col(grouped.columns[0])).alias("one"))
    out = wanted.join(told, "question", "left").join(asked, "question", "left").join(one, "question", "left")
    fresh = F.coalesce("fresh", F.lit(False)) & (F.col(grouped.columns[0]) == F.col("one"))
    tokens = [F.when(fresh, F.col(f"a.{c}")).otherwise(0).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")]
    return out.select(*grouped.columns, F.coalesce("a.raw_template", F.get(shown, F.lit(0))).alias("raw_template"), F.coalesce("a.failed", F.lit(True)).alias("failed"), fresh.alias("fresh"), *tokens)


def call_totals(proposals: DataFrame) -> DataFrame:
    """Calls and tokens; calls that failed count."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    calls = F.count_if("fresh") if "fresh" in proposals.columns else F.count("*")
    return proposals.agg(calls.alias("llm_calls"), total("input_tokens"), total("output_tokens"))
