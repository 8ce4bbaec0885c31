"""Partition log lines by token count, token position and the relation between two positions.

Lines never move as groups: only distinct token vectors with counts are shuffled, and every partition is a tuple of
key columns (token_len, s2_pos, s2_value, s3_side, s3_value) within its chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.sources.io import Saved, joinable, row_index

PART = ["chunk_id", "token_len", "s2_pos", "s2_value"]


def tokenise(logs: DataFrame, content: str = "Content") -> DataFrame:
    out = logs.filter(F.col(content).isNotNull()).withColumn("words", text.tokens(F.col(content)))
    out = out.withColumn("token_len", F.size("words"))
    return out if "chunk_id" in out.columns else out.withColumn("chunk_id", F.lit(0).cast("long"))


def chunked(logs: DataFrame, size: int) -> DataFrame:
    return logs.withColumn("chunk_id", F.floor(F.col("row_nr") / size).cast("long"))


def vectors(lines: DataFrame) -> DataFrame:
    """Distinct token vectors of a chunk with their lines and first line; all later steps read these."""
    return lines.groupBy("chunk_id", "token_len", "words").agg(F.count("*").alias("n"), F.min("row_nr").alias("first"))


def sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("chunk_id", "token_len").agg(F.count("*").alias("n"))


def cardinality(vec: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tokens at each position of each partition."""
    at = vec.select(*keys, F.posexplode("words").alias("pos", "token")).distinct()
    return at.groupBy(*keys, "pos").agg(F.count("*").alias("nu"))


def split_position(cards: DataFrame, keys: list[str]) -> DataFrame:
    low = cards.groupBy(*keys).agg(F.min(F.struct("nu", "pos")).alias("low"))
    return low.select(*keys, F.col("low.pos").alias("s2_pos"), F.col("low.nu").alias("min_nu"))


def constants(vec: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each position of each partition has one token (``same``), by two hashes; tasks pass on a row per position, no tokens."""
    at = vec.select(*keys, F.posexplode("words").alias("pos", "token"))
    at = at.select(*keys, "pos", F.xxhash64("token").alias("h"), F.xxhash64(F.lit("2"), "token").alias("g"))
    return at.groupBy(*keys, "pos").agg(((F.min("h") == F.max("h")) & (F.min("g") == F.max("g"))).alias("same"))


def _settled(table: DataFrame, saved: Saved | None) -> DataFrame:
    """A table of keys, written and broadcast where it is small, so that what it is joined with isn't shuffled by few keys."""
    return joinable(saved(table)) if saved else table


def s2(vec: DataFrame, saved: Saved | None = None) -> DataFrame:
    """Vectors with s2_pos and s2_value (null where a constant position exists or there are no tokens).

    Tokens are counted only for lengths without a constant position, whose first one is the split position otherwise.
    """
    keys = ["chunk_id", "token_len"]
    fixed = constants(vec, keys).groupBy(*keys).agg(F.min(F.when(F.col("same"), F.col("pos"))).alias("_fixed"))
    fixed = _settled(fixed, saved)
    split = split_position(cardinality(vec.join(fixed.filter("_fixed is null"), keys, "left_semi"), keys), keys)
    split = fixed.join(split, keys, "left").select(*keys, F.coalesce("_fixed", "s2_pos").alias("s2_pos"), F.col("_fixed").isNull().alias("_split"))
    out = vec.join(_settled(split, saved), keys, "left")
    return out.withColumn("s2_value", F.when(F.col("_split"), F.get("words", F.col("s2_pos")))).drop("_split")


def goodness(vec: DataFrame) -> DataFrame:
    """Share of constant positions in each partition, and its position table."""
    cards = cardinality(vec, PART)
    return cards.groupBy(*PART).agg(F.avg((F.col("nu") == 1).cast("int")).alias("goodness"), F.array_sort(F.collect_list(F.struct("pos", "nu"))).alias("nus"))


def pairs_of(part: DataFrame, limit: float, saved: Saved | None = None) -> DataFrame:
    """Partitions whose share of constant positions is at most ``limit``, with the pair of positions to compare (``pp``), if they have one.

    Tokens are counted in these alone; others are told by ``constants``.
    """
    poor = constants(part, PART).groupBy(*PART).agg(F.avg(F.col("same").cast("int")).alias("goodness")).filter(F.col("goodness") <= limit)
    todo = goodness(join_parts(part, _settled(poor.select(*PART), saved), "left_semi"))
    todo = todo.select(*PART, position_pair(F.col("nus")).alias("pp")).filter("pp is not null")
    return _settled(todo, saved)


def position_pair(nus: Column) -> Column:
    """The pair of positions to compare, from a sorted array<struct<pos,nu>>; null if there is none."""
    size = F.size(nus)
    values = F.filter(F.array_distinct(F.transform(nus, lambda x: x["nu"])), lambda v: v != 1)
    where = lambda v: F.transform(F.filter(nus, lambda x: x["nu"] == v), lambda x: x["pos"])
    hist = F.array_sort(F.transform(values, lambda v, i: F.struct((-F.size(where(v))).alias("m"), i.alias("i"), v.alias("v"))))
    low = F.array_sort(values)
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("int").alias("p1"), b.cast("int").alias("p2")))
    tie = (F.size(hist) >= 2) & (F.get(hist, F.lit(0))["m"] == F.get(hist, F.lit(1))["m"])
    a, b, top = where(F.get(low, F.lit(0))), where(F.get(low, F.lit(1))), where(F.get(hist, F.lit(0))["v"])
    tied = F.when(F.size(a) >= 2, pair(F.get(a, F.lit(0)), F.get(a, F.lit(1)))).otherwise(pair(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    rest = F.when(tie, tied).otherwise(pair(F.get(top, F.lit(0)), F.get(top, F.lit(1))))
    return F.when(size == 2, pair(F.lit(0), F.lit(1))).when((size > 2) & (F.size(hist) > 0), rest)


def join_parts(left: DataFrame, right: DataFrame, how: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Join on the partition keys; s2_pos and s2_value may be null."""
    keys = PART + extra
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(r[f"_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def relations(table: DataFrame, lower_bound: float) -> DataFrame:
    """c1, c2 (partners of v1 and of v2) and the side whose value names the leaf (null: stays)."""
    c1 = F.count("*").over(Window.partitionBy(*PART, "v1"))
    c2 = F.count("*").over(Window.partitionBy(*PART, "v2"))
    out = table.withColumns({"c1": c1, "c2": c2})
    few = 1 / F.col("n") < lower_bound
    side = (
        F.when((F.col("c1") > 1) & (F.col("c2") > 1), None)
        .when(F.col("c1") > 1, F.when(few, "v2").otherwise("v1"))
        .when(F.col("c2") > 1, F.when(few, "v1").otherwise("v2"))
        .otherwise("v1")
    )
    return out.withColumn("s3_side", side)


def relations_in_order(table: DataFrame, lower_bound: float, saved: Saved) -> DataFrame:
    """The same (without c1 and c2) visiting pairs by first line, each removed pair shrinking later counts.

    A pair with one partner left on a side is removed, so of the pairs of a token only its last one can go by that token's count, and only if all
    its others went by their other tokens.  So each token hangs from the other token of its last pair, and what a token needs is that no
    pair below it in this forest is stuck (the last pair of neither token).  Tokens above a stuck pair are found by pointer
    doubling: as many rounds of joins as the depth has binary digits, and no partition is ever in one task.
    """
    pair = F.struct("first", "v1", "v2")
    out = table
    for v in ("v1", "v2"):
        last = table.groupBy(*PART, v).agg(F.max(pair).alias("_last"))
        out = join_parts(out, last, "inner", [v]).withColumn(f"_is{v}", F.col("_last") == pair).drop("_last")
    out = saved(out)
    one, two = (F.struct(*PART, F.lit(v).alias("side"), F.col(v).alias("token")) for v in ("v1", "v2"))
    bad = out.filter("not _isv1 and not _isv2").select(F.explode(F.array(one, two)).alias("node")).distinct()
    bad = saved(bad)
    up = out.filter("_isv1 <> _isv2").select(F.when(F.col("_isv1"), one).otherwise(two).alias("node"), F.when(F.col("_isv1"), two).otherwise(one).alias("above"))
    more, step = bad, None
    while not more.isEmpty():
        step = saved(up if step is None else step.join(step.select(F.col("node").alias("above"), F.col("above").alias("next")), "above").select("node", F.col("next").alias("above")))
        more = saved(bad.join(step, "node").select(F.col("above").alias("node")).distinct().join(bad, "node", "left_anti"))
        bad = bad.unionByName(more)
    for v in ("v1", "v2"):
        of = bad.filter(F.col("node.side") == v).select("node.*").select(*PART, F.col("token").alias(v), F.lit(True).alias(f"_bad{v}"))
        out = join_parts(out, of, "left", [v])
    alone, few = {v: F.col(f"_is{v}") & F.col(f"_bad{v}").isNull() for v in ("v1", "v2")}, 1 / F.col("n") < lower_bound
    side = (
        F.when(alone["v1"] & alone["v2"], "v1")
        .when(alone["v2"], F.when(few, "v2").otherwise("v1"))
        .when(alone["v1"], F.when(few, "v1").otherwise("v2"))
    )
    return out.withColumn("s3_side", side).select(*table.columns, "s3_side")


def _supports(part: DataFrame, file_support: float, partition_support: float) -> DataFrame:
    """The partitions with their lines (_n), their chunk's lines (_total) and the step that made them too small (outlier), from one rollup."""
    totals = part.withColumn("_s2", F.struct("s2_pos", "s2_value")).rollup("chunk_id", "token_len", "_s2").agg(F.sum("n").alias("_n"), F.grouping_id().alias("_level"))
    at = lambda level, *keys: totals.filter(F.col("_level") == level).select(*keys)
    out = at(0, "chunk_id", "token_len", "_s2.*", "_n").join(at(1, "chunk_id", "token_len", F.col("_n").alias("_length")), ["chunk_id", "token_len"])
    out = out.join(at(3, "chunk_id", F.col("_n").alias("_total")), "chunk_id")
    small = lambda n: F.lit(file_support > 0) & (n / F.col("_total") < file_support)
    second = small(F.col("_n")) | (F.lit(partition_support > 0) & (F.col("_n") / F.col("_length") < partition_support))
    outlier = F.when(small(F.col("_length")), "S1").when(F.col("s2_value").isNotNull() & second, "S2")
    return out.select(*PART, "_n", "_total", outlier.alias("outlier"))


def leaves(
    vec: DataFrame, limit: float = 0.3, lower_bound: float = 0.25, static: bool = True, file_support: float = 0.0, partition_support: float = 0.0, saved: Saved | None = None
) -> DataFrame:
    """Every distinct token vector (of ``vectors``) with its leaf: the partition keys, s3_side and s3_value.

    p1, p2, v1, v2 are the compared positions and tokens where the partition went to the third step.  ``outlier`` names the step
    (S1, S2, S3) that made a partition with too little support; such a partition is a leaf and isn't split any further.  The
    sequential third step (not ``static``) writes its tables to ``saved``.
    """
    pruning = file_support > 0 or partition_support > 0
    part = s2(vec, saved)
    if pruning:
        part = join_parts(part, _supports(part, file_support, partition_support), "inner")
        part = part.withColumns({c: F.when(F.col("outlier") == "S1", None).otherwise(F.col(c)) for c in ("s2_pos", "s2_value")})
    else:
        part = part.withColumn("outlier", F.lit(None).cast("string"))
    todo = pairs_of(part.filter("outlier is null") if pruning else part, limit, saved)
    keyed = join_parts(part, todo, "left").withColumns({"p1": F.col("pp.p1"), "p2": F.col("pp.p2")}).drop("pp")
    keyed = keyed.withColumns({"v1": F.get("words", F.col("p1")), "v2": F.get("words", F.col("p2"))})
    table = keyed.filter("p1 is not null").groupBy(*PART, "v1", "v2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    rel = relations(table, lower_bound) if static else relations_in_order(table, lower_bound, saved or Saved(vec.sparkSession))
    out = join_parts(keyed, _settled(rel.select(*PART, "v1", "v2", "s3_side"), saved), "left", ["v1", "v2"])
    out = out.withColumn("s3_value", F.when(F.col("s3_side") == "v1", F.col("v1")).when(F.col("s3_side") == "v2", F.col("v2")))
    if pruning:
        third = [*PART, "s3_side", "s3_value"]
        share = out.filter("s3_side is not null").groupBy(*third).agg(F.sum("n").alias("_k"), F.first("_n").alias("_n"), F.first("_total").alias("_total"))
        few = (F.lit(file_support > 0) & (F.col("_k") / F.col("_total") < file_support)) | (F.lit(partition_support > 0) & (F.col("_k") / F.col("_n") < partition_support))
        out = join_parts(out.drop("_n", "_total"), share.filter(few).select(*third, F.lit("S3").alias("_third")), "left", ["s3_side", "s3_value"])
        out = out.withColumn("outlier", F.coalesce("outlier", "_third")).drop("_third")
    return out


def leaf_id(chunk: bool = True) -> Column:
    """A readable, unique text of the leaf's keys; without ``chunk``, leaves of several chunks with equal keys share it."""
    part = lambda c: F.coalesce(F.to_json(F.struct(c)), F.lit("{}"))
    first = [F.col("chunk_id").cast("string")] if chunk else []
    return F.concat_ws("|", *first, F.col("token_len").cast("string"), part("s2_pos"), part("s2_value"), part("s3_side"), part("s3_value"))


def assignment(lines: DataFrame, found: DataFrame, saved: Saved | None = None) -> DataFrame:
    """Every line with content, with its leaf.

    A line finds its leaf by three tables of keys (the split position of its length, the compared positions of its part, the
    side of its pair); lines aren't joined with token vectors.  ``found`` is read several times, so it should be a written table; with ``saved`` the
    tables of keys are written too and broadcast where they are small.
    """
    split = found.select("chunk_id", "token_len", "s2_pos", F.col("s2_value").isNotNull().alias("_split")).distinct()
    places = found.filter("p1 is not null").select(*PART, "p1", "p2").distinct()
    sides = found.filter("s3_side is not null").select(*PART, "v1", "v2", "s3_side").distinct()
    split, places, sides = (_settled(table, saved) for table in (split, places, sides))
    out = lines.join(split, ["chunk_id", "token_len"])
    out = out.withColumn("s2_value", F.when(F.col("_split"), F.get("words", F.col("s2_pos")))).drop("_split")
    out = join_parts(out, places, "left").withColumns({"v1": F.get("words", F.col("p1")), "v2": F.get("words", F.col("p2"))})
    out = join_parts(out, sides, "left", ["v1", "v2"])
    out = out.withColumn("s3_value", F.when(F.col("s3_side") == "v1", F.col("v1")).when(F.col("s3_side") == "v2", F.col("v2")))
    return out.drop("p1", "p2", "v1", "v2").withColumn("leaf", leaf_id())


def leaf_summary(found: DataFrame) -> DataFrame:
    """One row per leaf: lines, first line, the steps that made it (``trace``) and whether it is an outlier."""
    # all vectors of a leaf have one outlier: as a key it costs no sort, as the largest text it would
    out = found.groupBy(*PART, "s3_side", "s3_value", "outlier").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    trace = F.concat(F.lit("S1 "), F.when(F.col("s2_value").isNotNull(), "S2 ").otherwise(""), F.when(F.col("s3_side").isNotNull(), "S3 ").otherwise(""))
    return out.withColumn("trace", trace)


def in_order(summary: DataFrame, saved: Saved | None = None) -> DataFrame:
    """Leaves numbered by ``leaf_ord``: by the first line of their length, their part, then what stayed before the children; outliers last, by step."""
    by = lambda *keys: F.min("first").over(Window.partitionBy(*keys))
    side = F.when(F.col("s3_side").isNull(), 0).when(F.col("s3_side") == "v1", 1).otherwise(2)
    keys = summary.select("*", by("chunk_id", "token_len").alias("_a"), by(*PART).alias("_b"), side.alias("_c"))
    order = ["chunk_id", "outlier", "_a", "_b", "_c", "first"]
    return row_index(keys, *map(F.col, order), saved=saved).drop("_a", "_b", "_c").withColumnRenamed("row_nr", "leaf_ord")


def leaf_events(ordered: DataFrame, single_outlier_event: bool = False) -> DataFrame:
    """``in_order`` leaves with ``event``: e1, e2, … within a chunk, and outlier_e1, … for its outliers, or outlier_e for all of them."""
    late = F.col("outlier").isNotNull()
    start = ordered.groupBy("chunk_id", late.alias("_late")).agg(F.min("leaf_ord").alias("_start"))
    out = ordered.withColumn("_late", late).join(start, ["chunk_id", "_late"])
    number = (F.col("leaf_ord") - F.col("_start") + 1).cast("string")
    named = F.lit("outlier_e") if single_outlier_event else F.concat(F.lit("outlier_e"), number)
    return out.withColumn("event", F.when(F.col("_late"), named).otherwise(F.concat(F.lit("e"), number))).drop("_late", "_start")


def leaf_listing(assigned: DataFrame, ordered: DataFrame) -> DataFrame:
    """Every leaf's lines: leaf_ord, trace, token_len, n, outlier, row_nr and Content."""
    keys = ordered.withColumn("leaf", leaf_id()).select("leaf", "leaf_ord", "trace", "n", "outlier")
    return assigned.select("leaf", "token_len", "row_nr", "Content").join(keys, "leaf").drop("leaf")
