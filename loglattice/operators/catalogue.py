"""Match lines against a catalogue of templates: the cheapest full match wins.

On a full match the captured characters are the line's length less the template's literal length, so the winner is
the first hit in the order (literal length desc, slots desc, match frequency desc, insertion): one small sort, and a worker
stops at its first hit.  Templates without slots are plain equality: a lookup.

A catalogue of at most SLICE entries reaches the workers as a broadcast variable and is compiled once per worker.  A larger one is an inverted
index, a table: a template's whole literal tokens stand in every line that it matches, so each entry is listed under the rarest of its own, and a line meets
the entries listed under its tokens in one join.  Only entries without such a token (and all of a large catalogue on a stream, where lines aren't
shuffled) are sent slice after slice.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.operators.slots import UNSURE, compiled, scanned
from loglattice.sources.io import Saved, free_name, joinable, row_index, small

#: Entries that are held by the driver and sent to the workers at once.
SLICE = 20_000
#: Open signatures of a reconcile that one task solves.
AT_ONCE = 200_000
ORDER = ["literal_len", "n_slots", "match_frequency"]
FOUND = [("EventTemplate", "string"), ("ParameterList", "array<string>"), ("SlotTypes", "array<string>"), ("entry", "long")]
LISTS = ["ParameterList", "SlotTypes"]
_ENTRY = ["template", "slot_regexes", "slot_types", "insert_seq"]


def entries(templates: DataFrame) -> DataFrame:
    """Catalogue columns for a table with template (and optionally slot_regexes, slot_types, match_frequency, insert_seq)."""
    t = F.col("template")
    extra = {
        "slot_regexes": F.lit(None).cast("array<string>"), "slot_types": F.lit(None).cast("array<string>"),
        "match_frequency": F.lit(0).cast("long"), "insert_seq": F.lit(0).cast("long"),
    }
    out = templates.withColumns({k: v for k, v in extra.items() if k not in templates.columns})
    return out.withColumns({"pattern": text.pattern(t, F.col("slot_regexes")), "literal_len": text.literal_len(t), "n_slots": text.n_slots(t)})


def distinct(catalogue: DataFrame) -> DataFrame:
    """One entry per template and slot regexes: the earliest (ties: the smallest slot types), with the largest counter."""
    keys = ["template", "slot_regexes"]
    rest = ["insert_seq", "slot_types", "pattern", "literal_len", "n_slots"]
    one = catalogue.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("e"), F.max("match_frequency").alias("match_frequency"))
    return one.select("template", "slot_regexes", "e.slot_types", "match_frequency", *[f"e.{c}" for c in ("insert_seq", "pattern", "literal_len", "n_slots")])


def _order() -> list[Column]:
    return [*[F.desc(c) for c in ORDER], *insertion()]


def insertion() -> list[Column]:
    """The order of insertion, ties by content."""
    return [F.col("insert_seq"), F.col("template"), F.to_json(F.struct("slot_regexes"))]


def ordered(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(*_order())


def match_by_join(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The readable form, for small catalogues: every full match, then the cheapest per line."""
    hit = lines.join(F.broadcast(catalogue), F.expr("Content rlike pattern"))
    best = Window.partitionBy("row_nr").orderBy(*_order())
    return hit.withColumn("r", F.row_number().over(best)).filter("r = 1").select("row_nr", F.col("template").alias("EventTemplate"))


def _few(catalogue: DataFrame) -> list[tuple] | None:
    """The entries in matching order, or None if they are more than SLICE."""
    cut = catalogue.orderBy(*_order()).limit(SLICE + 1).select(*_ENTRY).collect()
    return [tuple(r) for r in cut] if len(cut) <= SLICE else None


def _slices(ranked: DataFrame) -> Iterator[list[tuple]]:
    """The entries (with their rank, from 0 without gaps), at most SLICE at a time."""
    at = 0
    while rows := ranked.filter(F.col("rank").between(at, at + SLICE - 1)).orderBy("rank").select(*_ENTRY).collect():
        yield [tuple(r) for r in rows]
        at += SLICE


def ranked(catalogue: DataFrame, saved: Saved | None = None) -> DataFrame:
    """Entries with their ``rank`` in the matching order."""
    return row_index(catalogue.select(*_ENTRY, *ORDER), *_order(), saved=saved).withColumnRenamed("row_nr", "rank").select("rank", *_ENTRY, "literal_len")


def index(catalogue: DataFrame, saved: Saved | None = None) -> DataFrame:
    """The inverted index: rank and entry under ``key``, the rarest of the template's whole literal tokens (ties: the longest); null if it has none."""
    saved = saved or Saved(catalogue.sparkSession)
    every = saved(ranked(catalogue, saved))
    own = F.array_distinct(F.filter(text.tokens(F.col("template")), lambda t: ~t.contains(text.SLOT)))
    listed = every.select("rank", F.explode(own).alias("key"))
    common = listed.groupBy("key").agg(F.count("*").alias("n"))
    rare = listed.join(common, "key").groupBy("rank").agg(F.min(F.struct("n", (-F.length("key")).alias("l"), "key")).alias("k"))
    return saved(every.join(rare.select("rank", "k.key"), "rank", "left"))


def candidates(lines: DataFrame, index_: DataFrame, own: str | None = None) -> DataFrame:
    """(row_nr, own, entry) of lines and the entries of an ``index`` that are listed under one of the lines' tokens."""
    mine = [own] if own else []
    tokens = lines.select("row_nr", "Content", *mine, F.explode(F.array_distinct(text.tokens(F.col("Content")))).alias("key"))
    return tokens.join(joinable(index_.filter("key is not null")), "key").filter(F.length("Content") >= F.col("literal_len")).drop("key", "literal_len")


_VALUES = "row_nr long, rank long, template string, slot_types array<string>, insert_seq long, values array<string>"


def _all_hits(lines: DataFrame, catalogue: DataFrame, own: str | None, saved: Saved) -> DataFrame:
    """Every match of lines (with row_nr) and entries of a large catalogue: _VALUES and ``own``."""
    mine = [own] if own else []
    schema = _VALUES + "".join(f", {c} long" for c in mine)
    listed = index(catalogue, saved)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, re.Pattern | None] = {}

        def fitted(line: str, t: str, s: list[str]) -> list[str] | None:
            if not s:
                values = scanned(line, t)
                if values is not UNSURE:
                    return values
            key = (t, tuple(s))
            if key not in known:
                if len(known) > SLICE:
                    known.clear()
                known[key] = compiled(t, s)
            m = known[key].fullmatch(line)
            return list(m.groups()) if m else None

        for b in batches:
            fits, values = [], []
            for i, (line, t, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("Content", "template", "slot_regexes")), strict=True)):
                found = fitted(line, t, s)
                if found is not None:
                    fits.append(i)
                    values.append(found)
            cut = b.take(pa.array(fits, pa.int64()))
            columns = {c: cut.column(c) for c in ("row_nr", "rank", "template", "slot_types", "insert_seq")}
            columns["values"] = pa.array(values, pa.list_(pa.string()))
            columns |= {c: cut.column(c) for c in mine}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    filled = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("slot_regexes", "slot_types")}
    out = candidates(lines, listed.withColumns(filled), own).mapInArrow(check, schema)
    loose = row_index(listed.filter("key is null").select("rank", *_ENTRY), F.col("rank"), saved=saved).withColumnRenamed("rank", "place").withColumnRenamed("row_nr", "rank")
    loose = saved(loose)
    for at, rows in enumerate(_slices(loose)):
        places = [r[0] for r in loose.filter(F.col("rank").between(at * SLICE, (at + 1) * SLICE - 1)).orderBy("rank").select("place").collect()]
        out = out.unionByName(lines.select("row_nr", "Content", *mine).mapInArrow(_each(_sent(lines.sparkSession, rows), places, mine), schema))
    return out


def _each(index_, places: list[int], mine: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = index_()
        for b in batches:
            rows = []
            for i, line in enumerate(b.column("Content").to_pylist()):
                for rank, values in entries.hits(line) if line is not None else ():
                    t, _, k, seq = entries.rows[rank]
                    rows.append((i, places[rank], t, k, seq, list(values)))
            cut = b.take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()))
            columns = {"row_nr": cut.column("row_nr").cast(pa.int64())}
            columns |= {c: pa.array([r[j + 1] for r in rows], kinds[j]) for j, c in enumerate(("rank", "template", "slot_types", "insert_seq", "values"))}
            columns |= {c: cut.column(c) for c in mine}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def match_by_key(lines: DataFrame, catalogue: DataFrame, own: str | None = None, keep_entry: bool = False, saved: Saved | None = None) -> DataFrame:
    """As ``match``, through the inverted index; ``lines`` need a unique row_nr."""
    found = _all_hits(lines, catalogue, own, saved or Saved(lines.sparkSession))
    later = F.lit(False)
    if own:
        found = found.filter(F.col("insert_seq") <= F.col(own))
        later = F.col("insert_seq") == F.col(own)
    entry = F.struct(F.col("template").alias("EventTemplate"), F.col("values").alias("ParameterList"), F.coalesce("slot_types", F.array().cast("array<string>")).alias("SlotTypes"), F.col("insert_seq").alias("entry"))
    best = found.groupBy("row_nr").agg(F.min_by(entry, F.struct(later.alias("later"), "rank")).alias("best"))
    names = [c for c, _ in FOUND]
    plain = [c for c in lines.columns if c not in names]
    out = lines.select(*plain).join(best, "row_nr", "left").select(*plain, *[F.col(f"best.{c}").alias(c) for c in names])
    return out if keep_entry else out.drop("entry")


class _Index:
    """Compiled entries in matching order; few of them are tried on a line."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.exact: dict[str, list] = defaultdict(list)
        self.heads: dict[str, list] = defaultdict(list)  # by the literal before the first slot: its first characters
        for rank, (t, s, _, _) in enumerate(rows):
            parts = t.split(text.SLOT)
            if len(parts) == 1:
                self.exact[t].append((rank, None, len(t)))
            else:
                self.heads[parts[0][:4]].append((rank, compiled(t, s), sum(map(len, parts))))
        self.tries: dict[str, list] = {}

    def hits(self, line: str) -> Iterator[tuple[int, tuple]]:
        """Ranks of the entries that match the line, in order, with the captured values."""
        head = line[:4]
        if head not in self.tries:
            if len(self.tries) > 50_000:
                self.tries.clear()
            self.tries[head] = sorted((e for n in range(len(head) + 1) for e in self.heads.get(head[:n], ())), key=lambda e: e[0])
        tries = self.tries[head]
        for rank, pattern, least in heapq.merge(self.exact[line], tries, key=lambda e: e[0]) if line in self.exact else tries:
            if pattern is None:
                yield rank, ()
            elif len(line) >= least:
                m = pattern.fullmatch(line)
                if m:
                    yield rank, m.groups()


_INDEXES: dict[str, _Index] = {}


def _sent(spark, rows: list[tuple]):
    """Gives every worker the index of ``rows``, compiled once."""
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(rows)

    def index() -> _Index:
        if key not in _INDEXES:
            if len(_INDEXES) > 3:
                _INDEXES.clear()
            _INDEXES[key] = _Index(sent.value)
        return _INDEXES[key]

    return index


def match(lines: DataFrame, catalogue: DataFrame, own: str | None = None, keep_entry: bool = False, saved: Saved | None = None) -> DataFrame:
    """``lines`` with EventTemplate, ParameterList and SlotTypes (null where nothing matches).

    ``own`` names a column with a line's own insert_seq: such a line takes the best entry that was inserted before its own, else its own.
    ``keep_entry`` adds the insert_seq of the entry.
    """
    few = _few(catalogue)
    if few is None and not lines.isStreaming and "row_nr" in lines.columns:
        return match_by_key(lines, catalogue, own, keep_entry, saved)
    names = [c for c, _ in FOUND]
    plain = [c for c in lines.columns if c not in names]
    sure = free_name(lines, "sure")
    schema = lines.select(*plain, *[F.lit(None).cast(t).alias(c) for c, t in FOUND], F.lit(False).alias(sure)).schema
    out = lines.select(*plain)
    for rows in [few] if few is not None else _slices(ranked(catalogue, saved)):
        out = out.withColumns(_filled(out)).mapInArrow(_best(_sent(lines.sparkSession, rows), own, sure), schema)
    told = F.col("EventTemplate").isNotNull()
    out = out.withColumns({c: F.when(told, F.col(c)) for c in LISTS})
    return out.drop(sure) if keep_entry else out.drop(sure, "entry")


def _filled(rows: DataFrame) -> dict[str, Column]:
    """The list columns of what was found so far with empty lists for nulls: a batch's nulls of a list column cost the square of their number on the way to Python."""
    return {c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS if c in rows.columns}


def _best(index, own: str | None, sure: str):
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.bool_())
    names = [*(c for c, _ in FOUND), sure]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = index()
        seen: dict[tuple, tuple | None] = {}

        def find(line: str, mine: int | None) -> tuple | None:
            spare = None
            for rank, values in entries.hits(line):
                t, _, k, seq = entries.rows[rank]
                if own is None or seq < mine:
                    return t, list(values), list(k or ()), seq, True
                if seq == mine:
                    spare = t, list(values), list(k or ()), seq, False
            return spare

        for b in batches:
            if sure in b.schema.names:
                old = [b.column(c).to_pylist() for c in names]
            else:  # nothing was looked for yet
                old = [*([[None] * b.num_rows] * len(FOUND)), [False] * b.num_rows]
            mine = b.column(own).to_pylist() if own else [None] * b.num_rows
            out = []
            for i, line in enumerate(b.column("Content").to_pylist()):
                found = None
                if line is not None and not old[4][i]:
                    key = (line, mine[i])
                    if key not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen[key] = find(*key)
                    found = seen[key]
                out.append(found or tuple(o[i] for o in old))
            cols = {c: b.column(c) for c in b.schema.names}
            cols |= {c: pa.array([f[j] for f in out], kinds[j]) for j, c in enumerate(names)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def hits(lines: DataFrame, catalogue: DataFrame, own: str, saved: Saved | None = None) -> DataFrame:
    """Distinct (own, hits): which entries that were inserted no later than its own leaf's a line matches (sorted)."""
    few = _few(catalogue)
    if few is None and "row_nr" in lines.columns:
        found = _all_hits(lines, catalogue, own, saved or Saved(lines.sparkSession)).filter(F.col("insert_seq") <= F.col(own))
        return found.groupBy("row_nr", own).agg(F.array_sort(F.collect_list("insert_seq")).alias("hits")).select(own, "hits").distinct()
    if few is not None:
        return lines.select("Content", own).mapInArrow(_each_once(_sent(lines.sparkSession, few), own), f"{own} long, hits array<long>").distinct()
    out = lines.select("Content", own, F.array().cast("array<long>").alias("hits"))
    for rows in _slices(ranked(catalogue, saved)):
        out = out.mapInArrow(_every(_sent(lines.sparkSession, rows), own), out.schema)
    return out.select(own, F.array_sort("hits").alias("hits")).filter(F.size("hits") > 0).distinct()


def _each_once(index, own: str):
    """What each line hits, in a task's batches what is new only: lines don't come back from Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = index()
        told: set[tuple] = set()
        for b in batches:
            new = []
            for line, mine in set(zip(b.column("Content").to_pylist(), b.column(own).to_pylist(), strict=True)):
                if line is None:
                    continue
                found = mine, tuple(sorted(s for s in (entries.rows[rank][3] for rank, _ in entries.hits(line)) if s <= mine))
                if found[1] and found not in told:
                    if len(told) > 100_000:
                        told.clear()
                    told.add(found)
                    new.append(found)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in new], pa.int64()), pa.array([f[1] for f in new], pa.list_(pa.int64()))], [own, "hits"])

    return run


def _every(index, own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = index()
        seen: dict[tuple, list] = {}
        for b in batches:
            out = []
            for line, mine, before in zip(b.column("Content").to_pylist(), b.column(own).to_pylist(), b.column("hits").to_pylist(), strict=True):
                key = (line, mine)
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seqs = (entries.rows[rank][3] for rank, _ in entries.hits(line))
                    seen[key] = [s for s in seqs if s <= mine]
                out.append(before + seen[key])
            yield pa.RecordBatch.from_arrays([b.column("Content"), b.column(own), pa.array(out, pa.list_(pa.int64()))], ["Content", own, "hits"])

    return run


def _in_order(signatures: DataFrame, own: str) -> DataFrame:
    """``own`` and kept of the entries of ``signatures`` (own, the open earlier entries), in one pass in their order; at most AT_ONCE rows in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keeps: dict[int, bool] = {}
        for mine, of in rows.sort_values(own).groupby(own, sort=True):
            keeps[mine] = any(not any(keeps.get(e, False) for e in earlier) for earlier in of["open"])
        return pd.DataFrame({own: list(keeps), "kept": list(keeps.values())})

    return signatures.groupBy(F.lit("all")).applyInPandas(run, f"{own} long, kept boolean")


def useful(seen: DataFrame, own: str, saved: Saved) -> DataFrame:
    """``own`` of the entries that a reconcile in order keeps: those that match a line of their own that no kept earlier entry matches.

    ``seen`` is that of ``hits``.  Entries with a line that they alone match are kept, and whatever a kept entry matches tells nothing of later ones.  What
    is open then is few signatures (entries, and which open earlier ones share their lines): up to AT_ONCE of them are solved in one
    ordered pass; of more, a round settles all whose earlier ones are settled, and the rest is looked at again.
    """
    mine = seen.filter(F.array_contains("hits", F.col(own))).select(own, F.array_remove("hits", F.col(own)).alias("earlier"))
    sure = F.max((F.size("earlier") == 0).cast("int")) == 1
    state = saved(mine.groupBy(own).agg(F.when(sure, True).alias("kept")))
    while not state.filter("kept is null").isEmpty():
        rest = mine.join(state.filter("kept is null"), own, "left_semi")
        before = state.select(F.col(own).alias("e"), F.lit(True).alias("there"), F.col("kept").alias("k"))
        told = rest.select(own, "earlier", F.explode("earlier").alias("e")).join(before, "e", "left")
        # an entry that matches no line of its own isn't in ``state``: it was never kept
        open_ = F.collect_set(F.when(F.col("there") & F.col("k").isNull(), F.col("e"))).alias("open")
        one = told.groupBy(own, "earlier").agg(F.max(F.coalesce("k", F.lit(False))).alias("blocked"), open_)
        one = saved(one.select(own, "blocked", F.when(F.col("blocked"), F.array().cast("array<long>")).otherwise(F.array_sort("open")).alias("open")).distinct())
        free = one.filter(~F.col("blocked"))
        if small(free, AT_ONCE):
            settled = one.select(own).distinct().join(_in_order(free.select(own, "open"), own), own, "left").select(own, F.coalesce("kept", F.lit(False)).alias("now"))
        else:
            ready = ~F.col("blocked") & (F.size("open") == 0)
            now = F.when(F.max(ready), True).when(F.min("blocked"), False)
            settled = one.groupBy(own).agg(now.alias("now"))
        state = saved(state.join(settled, own, "left").select(own, F.coalesce("kept", "now").alias("kept")))
    return state.filter("kept").select(own)


def kept(lines: DataFrame, new: DataFrame, own: str, saved: Saved) -> DataFrame:
    """The entries of ``new`` (a written table) that stay when leaves are reconciled in the order of insert_seq (``own`` of their lines).

    Of entries with equal templates and regexes only the first is tried, until lines are left that a later one would take.
    """
    kind = F.xxhash64("template", F.to_json(F.struct("slot_regexes"))).alias("kind")
    rep = new.groupBy(kind).agg(F.min("insert_seq").alias("rep"), F.count("*").alias("n"))
    alone = rep.filter("n > 1").isEmpty()
    if not alone:
        named = saved(new.select(F.col("insert_seq").alias(own), kind).join(rep, "kind").select(own, "rep"))
        tried = saved(named.select(F.col("rep").alias("insert_seq")).distinct())
    while True:
        entries_ = new if alone else saved(new.join(tried, "insert_seq", "left_semi"))
        seen = saved(hits(lines, entries_, own, saved))
        good = useful(seen, own, saved)
        if not alone:
            others = named.join(tried, F.col(own) == F.col("insert_seq"), "left_anti")
            rows = seen.join(others, own).filter(F.array_contains("hits", F.col("rep")))
            there = rows.select(own, "rep", "hits", F.explode("hits").alias("e")).join(good.select(F.col(own).alias("e"), F.lit(1).alias("k")), "e", "left")
            missed = there.groupBy(own, "rep", "hits").agg(F.max("k").alias("k")).filter("k is null")
            more = saved(missed.groupBy("rep").agg(F.min(own).alias("insert_seq")).select("insert_seq"))
            if not more.isEmpty():
                tried = saved(tried.unionByName(more))
                continue
        return entries_.join(good, F.col("insert_seq") == F.col(own), "left_semi")


def counts(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("EventTemplate").isNotNull()).groupBy(F.col("EventTemplate").alias("template")).agg(F.count("*").alias("match_frequency"))


def counted(catalogue: DataFrame, matched: DataFrame) -> DataFrame:
    """The catalogue with its entries' counters raised by a batch's matches (by entry, if ``matched`` tells it, else by template)."""
    key, mine = ("insert_seq", "entry") if "entry" in matched.columns else ("template", "EventTemplate")
    new = matched.filter(F.col(mine).isNotNull()).groupBy(F.col(mine).alias(key)).agg(F.count("*").alias("_more"))
    return catalogue.join(new, key, "left").withColumn("match_frequency", F.col("match_frequency") + F.coalesce("_more", F.lit(0))).select(*catalogue.columns)


def listing(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(F.desc("match_frequency"), "template")


def event_ids(templates: DataFrame, known: DataFrame | None = None, saved: Saved | None = None) -> DataFrame:
    """EventTemplate, EventId: E1..En by the templates' byte order; over distinct templates only.

    Templates in ``known`` (EventTemplate, EventId) keep their ids and new ones are numbered behind them.
    """
    distinct = templates.select("EventTemplate").filter(F.col("EventTemplate").isNotNull()).distinct()
    after = 0
    if known is not None:
        distinct = distinct.join(known, "EventTemplate", "left_anti")
        after = known.agg(F.max(F.substring("EventId", 2, 20).cast("long"))).first()[0] or 0
    ids = row_index(distinct, F.col("EventTemplate"), saved=saved)
    ids = ids.select("EventTemplate", F.concat(F.lit("E"), (F.col("row_nr") + 1 + after).cast("string")).alias("EventId"))
    return ids if known is None else known.select("EventTemplate", "EventId").unionByName(ids)


def result(matched: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The result table: noise lines have null event columns; unsorted (sort at the sink if needed)."""
    line = F.col("LineId") if "LineId" in matched.columns else F.col("row_nr")
    ids = event_ids(matched) if ids is None else ids
    return matched.join(joinable(ids), "EventTemplate", "left").select(line.alias("LineId"), "EventId", "Content", "EventTemplate", "ParameterList", "SlotTypes")


def run_stats(done: DataFrame) -> DataFrame:
    return done.agg(F.count("EventTemplate").alias("matched"), F.count_if(F.col("EventTemplate").isNull() & F.col("Content").isNotNull()).alias("noise"))
