"""CSV records with quoted line breaks, read by many tasks per file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = ["_a", "_b", "_block"]
_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
#: What a piece of a block is: a whole record, the rest of one that an earlier block began, the begin of one, the begin of a file's header.
_WHOLE, _REST, _BEGIN, _HEADER = range(4)
#: Up to this many blocks that begin or end inside a record are known to every task; beyond, lines are shuffled to their blocks.
_BROADCAST = 200_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes (or not) ends inside quotes.  Only a quote that begins a field opens, a doubled one doesn't close."""
    at = 0
    if not inside and line.startswith('"'):
        at, inside = 1, True
    while True:
        if inside:
            end = line.find('"', at)
            while end >= 0 and line.startswith('"', end + 1):
                end = line.find('"', end + 2)
            if end < 0:
                return True
            at = end + 1
        at = line.find(',"', at)
        if at < 0:
            return False
        at, inside = at + 2, True


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the block changes, with the block's key."""
    for batch in batches:
        cut = 0
        while cut < batch.num_rows:
            key = tuple(batch.column(c)[cut].as_py() for c in _BLOCK)
            same = pc.and_(pc.and_(pc.equal(batch.column("_a"), key[0]), pc.equal(batch.column("_b"), key[1])), pc.equal(batch.column("_block"), key[2]))
            n = pc.index(same.slice(cut), False).as_py()
            n = batch.num_rows - cut if n < 0 else n
            yield key, batch.slice(cut, n)
            cut += n


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: whether it ends inside quotes if it begins outside, and if it begins inside."""
    out: dict[tuple, list[bool]] = {}
    for key, part in _stretches(batches):
        state = out.setdefault(key, [False, True])
        quoted = part.column("value").filter(pc.match_substring(part.column("value"), '"'))
        for line in quoted.to_pylist():
            state[:] = [ends_inside(line, s) for s in state]
    names = [*_BLOCK, "_out", "_in"]
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, *v), strict=True)) for k, v in out.items()], pa.schema([(n, pa.int64()) for n in _BLOCK] + [(n, pa.bool_()) for n in names[3:]]))


_PIECES = pa.schema([*((n, pa.int64()) for n in _BLOCK), ("_nth", pa.int64()), ("_kind", pa.int32()), ("_record", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's records and what it has of those that pass its ends; headers are left out.  ``_inside``: the block begins inside quotes."""
    key, inside, kind, held, nth = None, False, _WHOLE, [], 0

    def piece(k: int, lines: list[str]) -> tuple:
        return (*key, nth, k, "\n".join(lines))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    for here, part in _stretches(batches):
        rows: list[tuple] = []
        if here != key:
            if held:  # the block before ended inside a record
                rows.append(piece(_BEGIN if kind == _WHOLE else kind, held))
            key, inside, held, nth = here, bool(part.column("_inside")[0].as_py()), [], 0
            kind = _REST if inside else _HEADER if here[2] == 0 else _WHOLE
        values = part.column("value")
        quotes = pc.match_substring(values, '"')
        if kind == _WHOLE and not inside and not pc.any(quotes).as_py():  # every line is a record
            n = len(values)
            fixed = [pa.repeat(pa.scalar(x, t), n) for x, t in zip((*key, 0, _WHOLE), _PIECES.types, strict=False)]
            fixed[3] = pa.array(range(nth, nth + n), pa.int64())
            if rows:
                yield table(rows)
            yield pa.RecordBatch.from_arrays([*fixed, values.cast(pa.string())], schema=_PIECES)
            nth += n
            continue
        for line, quoted in zip(values.to_pylist(), quotes.to_pylist(), strict=True):
            held.append(line)
            inside = ends_inside(line, inside) if quoted else inside
            if not inside and not (kind == _HEADER and not line.strip()):  # empty lines may come before a header
                if kind != _HEADER:
                    rows.append(piece(kind, held))
                kind, held = _WHOLE, []
                nth += 1
        if rows:
            yield table(rows)
    if held:
        yield table([piece(_BEGIN if kind == _WHOLE else kind, held)])


def read_csv(spark: SparkSession, path: str, schema: str | None = None, bad: str | None = None, place: str | None = None) -> DataFrame:
    """Rows of CSV files with headers and quotes as RFC 4180 has them, line breaks in quotes included; large files are read in blocks by many tasks.

    A block of a file can begin inside quotes.  The first pass finds for each block where it would end, inside or outside, from either begin;
    putting these together in order tells where each begins.  The second pass cuts blocks into records; only those that pass the end of a
    block are shuffled, as a piece from each of its blocks.  Passes read the same files, so these mustn't change meanwhile.

    Without ``schema`` the first file's header names text columns.  Fields that don't fit the schema are null; ``bad`` names a column that then holds
    the record as it was.  ``place`` names a column that orders the rows of a file (file, block, number).  Empty lines are left out, as is the \\r before
    a record's line break; a quote inside an unquoted field is a character like others, and quotes open at a file's end close there.
    """
    fields = spark.read.options(header=True, **_OPTIONS).csv(path).schema if schema is None else spark.createDataFrame([], schema).schema
    options = dict(_OPTIONS)
    if bad:
        fields, options["columnNameOfCorruptRecord"] = fields.add(bad, "string"), bad
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.xxhash64("_metadata.file_path").alias("_a"), F.xxhash64(F.lit("b"), "_metadata.file_path").alias("_b"), F.col("_metadata.file_block_start").alias("_block")
    )
    crossed = _crossed(lines.mapInArrow(_effects, "_a long, _b long, _block long, _out boolean, _in boolean"))
    rows = crossed.limit(_BROADCAST + 1).collect()
    few = len(rows) <= _BROADCAST
    if few:
        crossed = F.broadcast(spark.createDataFrame(rows, crossed.schema))
    schema_ = "_a long, _b long, _block long, _nth long, _kind int, _record string"

    def pieces(how: str) -> DataFrame:
        if few:  # a join by broadcast leaves lines in their places
            placed = lines.join(crossed, _BLOCK, how)
        else:
            placed = lines.withColumn("_line", F.monotonically_increasing_id()).join(crossed, _BLOCK, how)
            placed = placed.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "_line").drop("_line")
        return placed.mapInArrow(_pieces, schema_)

    order = F.struct("_a", "_block", "_nth").alias("_place")
    if rows:
        every = pieces("left").filter(F.col("_kind") == _WHOLE).select(order, "_record").unionByName(_joined(pieces("inner").filter(F.col("_kind") != _WHOLE)))
    else:
        every = lines.withColumn("_inside", F.lit(False)).mapInArrow(_pieces, schema_).select(order, "_record")
    record = F.when(F.col("_record").endswith("\r"), F.substring("_record", 1, F.length("_record") - 1)).otherwise(F.col("_record"))
    every = every.withColumn("_record", record).filter("_record <> ''")
    out = every.select(F.from_csv("_record", fields.toDDL(), options).alias("_row"), "_place")
    return out.select("_row.*", *([F.col("_place").alias(place)] if place else []))


def _crossed(effects: DataFrame) -> DataFrame:
    """The blocks that begin or end inside quotes (``_inside``, ``_ends``).

    A block's effect is to end as it begins, to end always inside or always outside, or to swap; what counts is the last block with a fixed end and
    whether the swaps behind it are odd.
    """
    file = Window.partitionBy("_a", "_b").orderBy("_block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    steps = effects.withColumn("_swaps", F.sum((F.col("_out") & ~F.col("_in")).cast("long")).over(file))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("to"), F.col("_swaps").alias("n")))
    steps = steps.withColumns({"_last": F.last(fixed, True).over(before), "_n": F.coalesce(F.lag("_swaps").over(file), F.lit(0))})
    swapped = (F.col("_n") - F.coalesce(F.col("_last.n"), F.lit(0))) % 2 == 1
    steps = steps.withColumn("_inside", F.coalesce(F.col("_last.to"), F.lit(False)) != swapped)
    return steps.select(*_BLOCK, "_inside", F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out")).alias("_ends")).filter("_inside or _ends")


def _joined(parts: DataFrame) -> DataFrame:
    """Records from their pieces: each begins one, those after it up to the next begin go on with it."""
    chain = F.sum((F.col("_kind") != _REST).cast("long")).over(Window.partitionBy("_a", "_b").orderBy("_block", "_nth"))
    rows = parts.withColumn("_chain", chain).groupBy("_a", "_b", "_chain").agg(F.array_sort(F.collect_list(F.struct("_block", "_nth", "_kind", "_record"))).alias("_all"))
    first = F.col("_all")[0]
    return rows.filter(first["_kind"] == _BEGIN).select(
        F.struct("_a", first["_block"].alias("_block"), first["_nth"].alias("_nth")).alias("_place"), F.array_join(F.transform("_all", lambda x: x["_record"]), "\n").alias("_record")
    )
