"""Small things that several operators of this subpackage share.

Row identity.  Operators that order documents or join back to them use two internal columns:
``_did`` (the integer ``doc_id``, a null taken as the smallest long) and ``_tk`` (a 64-bit hash of the
text).  Rows that agree in both are repetitions of one row and all get the same result.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources.io import joinable, remove, shared_folder, small

__all__ = ["joinable", "small"]
#: The two internal identity columns.
DID, TKEY = "_did", "_tk"
#: What a null doc_id counts as.
NULL_ID = -(2**63)
_here = threading.local()  # scopes are a thread's own, so that several runs in one driver don't meet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, nothing depends on one executor."""
    out, path = _written(df)
    if getattr(_here, "scopes", None):
        _here.scopes[-1].append(path)
    return out


@contextmanager
def scope(spark: SparkSession):
    """Gives a function that writes a table as ``stash`` does; tables that are stashed otherwise inside are removed at the end."""
    if not hasattr(_here, "scopes"):
        _here.scopes = []
    _here.scopes.append([])
    try:
        yield lambda df: _written(df)[0]
    finally:
        for path in _here.scopes.pop():
            remove(spark, path)


def tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written where it stashes tables, so that these are gone when it returns; only the result's table stays."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scope(spark) as written:
            out = query(spark, sf_dir)
            return written(out) if _here.scopes[-1] else out

    return run


def _keys(text: str, doc_id: str) -> tuple[Column, Column, Column]:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias(DID), F.xxhash64(body).alias(TKEY), body.alias("text")


def carried(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``_did``, ``_tk`` and each whole row as the struct ``row``, so that no name of the user's can clash with internal ones."""
    did, tk, _ = _keys(text, doc_id)
    return docs.select(did, tk, F.struct("*").alias("row"))


def identified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only what the operators need: ``_did``, ``_tk``, ``doc_id`` and ``text`` (null text: empty)."""
    did, tk, body = _keys(text, doc_id)
    return docs.select(did, tk, F.col(doc_id).cast("long").alias("doc_id"), body)


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once a row (the optimizer may copy a column into a lambda that runs per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(docs: DataFrame) -> DataFrame:
    """As ``identified``, but ``_tk`` is 0 unless several rows have the doc_id: a constant costs nothing in a shuffle."""
    own = identified(docs)
    again = own.groupBy(DID).agg(F.count("*").alias("_n")).filter("_n > 1").select(DID, F.lit(True).alias("_again"))
    marked = own.join(joinable(again), DID, "left")
    return marked.select(DID, F.when(F.col("_again"), F.col(TKEY)).otherwise(F.lit(0).cast("long")).alias(TKEY), "doc_id", "text")


def pressed(docs: DataFrame) -> DataFrame:
    """``text`` as compressed bytes ``z``, for rows that are about to be shuffled whole."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [press(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(DID), b.column(TKEY), b.column("doc_id"), pa.array(z, pa.binary())], [DID, TKEY, "doc_id", "z"])

    return docs.select(DID, TKEY, "doc_id", "text").mapInArrow(run, f"{DID} long, {TKEY} long, doc_id long, z binary")


def unpressed(column) -> list[bytes]:
    """The texts of an Arrow column of compressed bytes."""
    import zstandard

    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``carried`` rows of ``docs`` that aren't in ``gone`` (_did, _tk), which is broadcast if its counted size allows; else texts are shuffled."""
    return carried(docs).join(joinable(stash(gone)), [DID, TKEY], "left_anti")


def one_each(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The user's rows of ``carried`` ones, of repeated rows any one; ``keys``: _did and _tk of all of them.  Only repeated rows are shuffled."""
    again = stash(keys.groupBy(DID, TKEY).agg(F.count("*").alias("n")).filter("n > 1").select(DID, TKEY))
    if again.isEmpty():
        return rows.select("row.*")
    again = joinable(again)
    once = rows.join(again, [DID, TKEY], "left_semi").dropDuplicates([DID, TKEY])
    return rows.join(again, [DID, TKEY], "left_anti").unionByName(once).select("row.*")
