"""Near-duplicates by SimHash fingerprints, with pivot distance tables.

* Every document gets a 64-bit fingerprint; only distinct fingerprints go on, so copies cost nothing more.
* Candidates: two fingerprints that differ in at most 2 of 4 stretches of 16 bits agree in 2 whole stretches, so they
  meet under one of 6 keys of 32 bits (exact: no link is lost).
* Pivot table: the Hamming distances of a fingerprint to PIVOTS reference fingerprints.  Distance obeys the
  triangle inequality, so a pair whose tables differ by more than the limit in any coordinate is discarded
  unseen; survivors are verified.  (Pivots alone can't bound the candidates of a large table - each halves them
  only - so the keys come first.)
* A key with more rows than BLOCK is dealt out in pairs of blocks, each a group of its own: exact and bounded.
  Within a group of many rows only a spanning forest of its links is returned.

Defined results: null or empty text has fingerprint zero and links like any other; a null ``doc_id`` is ignored in
the minimum that names a component (null if there is no other); repeated rows share everything (``keep_one`` keeps one of them); texts of one
doc_id are told apart; texts of any length are taken whole; an empty table gives an empty one; other columns may have any names and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DID, TKEY, identified, one_each, stash, table, without
from .components import components

SHINGLE, LIMIT, SEED = 3, 2, 42
#: Rows of a key that are compared in one group.
BLOCK = 4096
#: The reference fingerprints: pseudo-random, equal on every worker.
PIVOTS = np.random.default_rng(20240229).integers(0, 2**64, 12, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(grams)
    for i in range(0, n, 65536):
        h = np.array([digest(g, SEED) for g in grams[i : i + 65536]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_did, _tk, doc_id and the fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(DID), b.column(TKEY), b.column("doc_id"), pa.array(fp.view(np.int64))], [DID, TKEY, "doc_id", "fp"])

    return docs.select(DID, TKEY, "doc_id", "text").mapInArrow(run, f"{DID} long, {TKEY} long, doc_id long, fp long")


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot distance table of some fingerprints."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _forest(fp: np.ndarray, far: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of a group's links: each fingerprint is taken up once, against those not reached yet."""
    left, out = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.abs(far[left, 0] - far[x, 0]) <= limit
            for p in range(1, far.shape[1]):
                if not near.any():
                    break
                near &= np.abs(far[left, p] - far[x, p]) <= limit
            hit = np.flatnonzero(near)
            hit = hit[np.bitwise_count(fp[left[hit]] ^ fp[x]) <= limit]
            if len(hit):
                out += [(x, y) for y in left[hit]]
                queue += list(left[hit])
                left = np.delete(left, hit)
    return out


def _links(limit: int):
    shifts = 24

    def within(keys: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Links of complete groups (rows sorted by key), as pairs of row numbers."""
        far = distances(fp)
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(start, len(keys)))
        group = np.repeat(count, count)
        pairs = []
        few = np.flatnonzero(group <= shifts)
        for d in range(1, shifts):
            a = few[few + d < len(keys)]
            a = a[keys[a] == keys[a + d]]
            if not len(a):
                break
            a = a[np.abs(far[a] - far[a + d]).max(axis=1) <= limit]
            a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= limit]
            pairs.append(np.stack([a, a + d], 1))
        for s, n in zip(start[count > shifts], count[count > shifts], strict=True):
            f = _forest(fp[s : s + n], far[s : s + n], limit)
            if f:
                pairs.append(np.array(f, np.int64) + s)
        return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for b in batches:
            keys = np.concatenate((held[0], b.column("k").to_numpy()))
            fp = np.concatenate((held[1], b.column("fp").to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            cut = int(np.searchsorted(-(keys[::-1] == keys[-1]).astype(np.int8), 0))  # rows of the last key
            cut = len(keys) - cut
            p = within(keys[:cut], fp[:cut]) if cut else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[p[:, i]].view(np.int64)) for i in (0, 1)], ["u", "v"])
            held = [keys[cut:], fp[cut:]]
        if len(held[0]):
            p = within(*held)
            yield pa.RecordBatch.from_arrays([pa.array(held[1][p[:, i]].view(np.int64)) for i in (0, 1)], ["u", "v"])

    return run


def links(distinct: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between fingerprints at most ``limit`` (2 or fewer) bits apart; within dense groups a spanning forest."""
    if not 0 <= limit <= 2:
        raise ValueError("the keys are made for limits up to 2")
    part = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.xxhash64(F.lit(10 * i + j), part[i], part[j]) for i in range(4) for j in range(i)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k"))
    many = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(many, "k").withColumn("b", F.ceil(F.col("n") / block).cast("int"))
    plain = rows.filter("b = 1").select("k", "fp")
    mine = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("b")).cast("int")
    blocks = (
        rows.filter("b > 1")
        .select("k", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
        .select(F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("k"), "fp")
    )
    return plain.unionByName(blocks).repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_links(limit), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """Every row's _did, _tk, doc_id, fp and the component it is in: its root fingerprint, smallest doc_id and first row."""
    rows = stash(fingerprints(identified(docs), shingle))
    own = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(F.struct(DID, TKEY)).alias("row")))
    roots = components(links(own, limit))
    named = own.join(roots, own["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "row")
    named = stash(named)
    linked = named.join(named.filter("fp <> root").select("root").distinct(), "root", "left_semi")
    whole = linked.groupBy("root").agg(F.min("low").alias("c_low"), F.min("row").alias("c_row"))
    table_ = named.join(whole, "root", "left").select("fp", "root", F.coalesce("c_low", "low").alias("component_id"), F.coalesce("c_row", "row").alias("first"))
    return rows.join(table_, "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """The first row (smallest doc_id) of each component; of repeated rows one."""
    found = near_duplicates(docs, shingle, limit)
    gone = found.filter((F.col(f"first.{DID}") != F.col(DID)) | (F.col(f"first.{TKEY}") != F.col(TKEY))).select(DID, TKEY).distinct()
    return one_each(without(docs, gone), found)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``documents``."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The same by comparing all pairs, for tests."""
    fps = []
    for _, t in rows:
        w = [x for x in (t or "").encode().lower().split()]
        g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)]
