"""Spelling variants by pairs of trie nodes.

All frequent words form a trie, all reversed words another.  Their nodes are numbered: of the words in order, the first that has a prefix
makes its node, and (that word's rank, depth) is the node's number.  A word that is cut at a place is a pair of nodes, what stands before and what
stands behind it.  Words that share a pair *around* one letter differ in that letter; a word whose pair around a letter is the pair *between* two letters of
another has that letter inserted.  So exact neighbours meet under equal pairs of integers, no strings are compared, and every word makes 2 x length + 1
pairs.  Words that share a pair around one letter are at most as many as there are letters, so groups are small however hot a text is.

Ranks come in stretches of STRETCH words; within one, nodes are numbered in one pass over common prefixes with the word before.  What a stretch
shares with words before it is told by one row per stretch (the path of its last word), joined back.

Defined results: null and empty texts have no words; a null doc_id counts as an empty text in the hash that deletes letters; repeated rows count each; of a
letter that stands twice side by side either may be deleted, which is one neighbour; of equally frequent neighbours the first in code-point order is
the form; words may have up to 16,777,215 letters (a longer one is an error); texts are taken whole; an empty table gives an empty one; other columns may
have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources.io import row_index

from .common import joinable, stash, table

LETTERS, COUNT, FACTOR = 5, 3, 2
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
STRETCH = 20_000
_DEPTH = 1 << 24
_RUN = re.compile(r"[a-zÀ-ÿ]+")
_PATH = "array<struct<upto:int,made:long>>"


def _taken(doc_id: int | None, run: str, every: int) -> str:
    """The run, without one letter if its hash is divisible by ``every`` (op12's contract)."""
    data = run.encode()
    h = zlib.crc32(data, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, every: int = 0) -> DataFrame:
    """word, n of the lower-cased words of at least ``letters`` letters that occur ``count`` times or more.

    ``every`` = 97 first deletes letters as op12's contract says; 0 takes words as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            one = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return one

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not t:
                    continue
                for w, n in Counter(_RUN.findall(t.lower().decode())).items():  # of bytes, only A-Z are lower-cased
                    if len(w) >= letters:
                        if every:
                            w = _taken(doc_id, w, every)
                            if len(w) < letters:
                                continue
                        held[w] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def paths(ranked: DataFrame) -> DataFrame:
    """wid and ``path`` of rows (rank, wid, word; ranks from 0 in the order of the words): which rank made the word's nodes up to which depth."""
    whole = ranked.select("rank", "wid", "word", F.floor(F.col("rank") / STRETCH).cast("long").alias("part"))
    before = whole.filter(F.col("rank") % STRETCH == STRETCH - 1).withColumns({"part": F.col("part") + 1, "wid": F.lit(None).cast("long")})

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        path: list[tuple[int, int]] = []
        last, out = None, []
        for rank, wid, word in zip(rows["rank"], rows["wid"], rows["word"], strict=True):
            if len(word) >= _DEPTH:
                raise ValueError("a word has too many letters")
            if last is None and wid != wid:  # the last word of the stretch before
                last, path = word, [(len(word), -1)]
                continue
            same = _common(last, word) if last is not None else 0
            while path and (path[-2][0] if len(path) > 1 else 0) >= same:
                path.pop()
            if path:
                path[-1] = (same, path[-1][1])
            path.append((len(word), rank))
            last = word
            out.append((rank, int(wid), [{"upto": u, "made": m} for u, m in path]))
        return pd.DataFrame(out, columns=["rank", "wid", "path"])

    made = stash(whole.unionByName(before).groupBy("part").applyInPandas(numbered, f"rank long, wid long, path {_PATH}"))
    ends = made.filter(F.col("rank") % STRETCH == STRETCH - 1).orderBy("rank").select("rank", "path")
    starts, open_ = [], []
    for rank, path in ends.toLocalIterator():  # one row per stretch
        path = [(s["upto"], s["made"]) for s in path]
        if path[0][1] == -1:
            depth, *_ = path[0]
            kept = [(min(u, depth), m) for k, (u, m) in enumerate(open_) if k == 0 or open_[k - 1][0] < depth]
            path = kept + path[1:]
        open_ = path
        starts.append((rank // STRETCH + 1, path))
    start = joinable(stash(made.sparkSession.createDataFrame(starts, f"part long, start {_PATH}")))
    depth, begin = F.col("path")[0]["upto"], F.col("start")
    kept = F.filter(begin, lambda s, i: (i == 0) | (F.get(begin, i - 1)["upto"] < depth))
    kept = F.transform(kept, lambda s: F.struct(F.least(s["upto"], depth).alias("upto"), s["made"].alias("made")))
    full = F.when(F.col("path")[0]["made"] == -1, F.concat(kept, F.slice("path", 2, F.size("path")))).otherwise(F.col("path"))
    return made.withColumn("part", F.floor(F.col("rank") / STRETCH).cast("long")).join(start, "part", "left").select("wid", full.alias("path"))


def pairs(listed: DataFrame) -> DataFrame:
    """Node pairs (p, s) of words (wid, n, word): kind 0 between two letters, 1 around a letter, 2 around one that the letter before equals."""
    ahead = paths(listed.select(F.col("wid").alias("rank"), "wid", "word"))
    turned = row_index(listed.select("wid", F.reverse("word").alias("word")), F.col("word"), saved=stash).withColumnRenamed("row_nr", "rank")
    behind = paths(turned.select("rank", "wid", "word"))
    rows = listed.join(ahead.withColumnRenamed("path", "ahead"), "wid").join(behind.withColumnRenamed("path", "behind"), "wid")

    def nodes(path: list[dict], size: int) -> np.ndarray:
        """Numbers of the nodes of depth 0 to ``size``."""
        upto = np.array([s["upto"] for s in path])
        made = np.array([s["made"] for s in path], np.int64)
        out = np.repeat(made, np.diff(np.concatenate(([0], upto)))) * _DEPTH + np.arange(1, size + 1)
        return np.concatenate(([0], out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "s", "kind", "n", "wid"]

        def out(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

        for b in batches:
            held, size = [], 0
            for wid, n, word, f, r in zip(*(b.column(c).to_pylist() for c in ("wid", "n", "word", "ahead", "behind")), strict=True):
                m = len(word)
                p, s = nodes(f, m), nodes(r, m)[::-1]  # s[i]: what stands behind place i
                letter = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                kind = np.where(np.concatenate(([False], letter[1:] == letter[:-1])), 2, 1)
                held.append((np.concatenate((p, p[:-1])), np.concatenate((s, s[1:])), np.concatenate((np.zeros(m + 1, np.int32), kind)).astype(np.int32), np.full(2 * m + 1, n), np.full(2 * m + 1, wid)))
                size += m
                if size > 500_000:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    return rows.select("wid", "n", "word", "ahead", "behind").mapInArrow(run, "p long, s long, kind int, n long, wid long")


def neighbours(listed: DataFrame) -> DataFrame:
    """wid, n_near and ``best`` (less: -n, wid) of the words (wid, n, word) that have near words."""
    member = F.struct((-F.col("n")).alias("less"), "wid", "kind")
    # at most one word between two letters, and one around each letter of the alphabet: a group has 91 members at most
    groups = pairs(listed).groupBy("p", "s").agg(F.collect_list(member).alias("all")).filter((F.size("all") > 1) & F.exists("all", lambda m: m["kind"] > 0))
    one = groups.select("all", F.explode("all").alias("m"))

    def others(m: Column) -> Column:
        swapped = F.filter("all", lambda x: (x["kind"] > 0) & (x["wid"] != m["wid"]))
        longer = F.filter("all", lambda x: x["kind"] == 1)
        shorter = F.filter("all", lambda x: x["kind"] == 0)
        return F.when(m["kind"] == 0, longer).when(m["kind"] == 2, swapped).otherwise(F.concat(swapped, shorter))

    told = one.select(F.col("m.wid").alias("wid"), others(F.col("m")).alias("near")).filter(F.size("near") > 0)
    least = F.array_min(F.transform("near", lambda x: F.struct(x["less"].alias("less"), x["wid"].alias("wid"))))
    return told.groupBy("wid").agg(F.sum(F.size("near")).alias("n_near"), F.min(least).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """The end of each chain of ``links`` (wid, to); every round doubles the steps, and n at least doubles with each step, so rounds are few."""
    at = stash(links)
    while True:
        ahead = joinable(at.select(F.col("wid").alias("to"), F.col("to").alias("next")))
        step = stash(at.join(ahead, "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        at = step.select("wid", "to")
        if step.filter("moved").isEmpty():
            return at


def group_variants(found: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words (word, n)."""
    listed = stash(row_index(found.select("word", "n"), F.col("word"), saved=stash).select(F.col("row_nr").alias("wid"), "n", "word"))
    near = listed.join(neighbours(listed), "wid", "left")
    best = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best"))
    near = stash(near.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-best["less"]).alias("form_n"), best["wid"].alias("to")))
    ends = roots(near.filter("to is not null").select("wid", "to")).withColumnRenamed("to", "end")
    linked = near.filter("to is not null").join(ends, "wid")
    name = lambda key, to: listed.select(F.col("wid").alias(key), F.col("word").alias(to))
    linked = linked.join(name("to", "form"), "to").join(name("end", "root"), "end")
    alone = near.filter("to is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.select(*alone.columns).unionByName(alone)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of ``documents``, letters deleted by the contract, with its form and root."""
    return group_variants(stash(words(table(spark, sf_dir, "documents"), every=97)))


def brute(found: dict[str, int], factor: int = FACTOR) -> set[tuple]:
    """The same by comparing all pairs, for tests."""

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w, n in found.items():
        others = [x for x in found if near(w, x)]
        count[w] = len(others)
        top = min(others, key=lambda x: (-found[x], x), default=None)
        form[w] = top if top is not None and found[top] >= factor * n else None

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, count[w], found[form[w]] if form[w] is not None else None) for w, n in found.items()}
