"""Near-duplicates by the sets of their five-word shingles: every pair with a Jaccard similarity of 0.8 or more links.

* A row's shingles are 64-bit hashes of five lower-cased words in a row (of all words where there are fewer); rows with
  equal sets are one node.
* SimHash: rows get op4's fingerprint, of five-word shingles; fingerprints at most two bits apart (found by its keys and pivot
  tables, see ``simhash``) are the first pairs.  Fingerprints miss edited copies and may join others, so their pairs are
  verified like all, and the prefix filter finds every link that they miss.
* Prefix filter: in any fixed order of all shingles, two sets of similarity 0.8 share one of the first
  n - ceil(0.8 n) + 1 shingles of each, so they meet under one of these keys (exact: no link is lost).  The order puts
  shingles that are frequent in a sixteenth of the documents last.  It only decides how many candidates meet, not the result.
* First the smallest node of a key is compared with the key's others (at most STARS such pairs a node), which joins large
  groups of near copies without all their pairs.  Then every two nodes of a key that are in different components so far
  are candidates, unless their sizes or the number of keys they share exclude the similarity.
* Every candidate is verified on the whole sets, in integers.  Keys with more than BLOCK nodes are dealt out in pairs of blocks.

Defined results: null and empty texts have the empty set and are copies of each other; of repeated rows one stays; of a component the smallest
doc_id stays (a null is the smallest), of several texts of it that with the smallest hash; texts of any length are taken whole; an empty table
gives an empty one; other columns may have any names and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import DID, TKEY, identified, joinable, one_each, small, stash, without
from .components import components

SHINGLE, SEED = 5, 42
#: The first pairs of a node; these only save later ones.
STARS = 4
#: Nodes of a key that are compared in one group.
BLOCK = 512
#: One in SHARE documents is counted for the order; at most FREQUENT shingles are sent to the workers.
SHARE, FREQUENT = 16, 500_000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the counted documents have (sorted), and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    part = docs.filter(F.pmod(TKEY, F.lit(SHARE)) == 0).select("text").mapInArrow(run, "h long")
    counts, least = stash(part.groupBy("h").agg(F.count("*").alias("n")).filter("n >= 4")), 4
    while not small(counts.filter(F.col("n") >= least), FREQUENT):
        least *= 2
    found = counts.filter(F.col("n") >= least).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _keyed(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """_did, _tk, the node, its number of shingles n, its keys and the fingerprint fp, of every row."""
    known, weight = frequent

    def first(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        w = np.zeros(len(s), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            w = np.where(known[at] == s, weight[at], 0)
        return s[np.lexsort((s, w))[: len(s) - (4 * len(s) + 4) // 5 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(t) for t in texts]
            fp = np.array([simhash.fingerprint(t, SHINGLE) for t in texts], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = [first(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(DID), b.column(TKEY), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp)], [DID, TKEY, "node", "n", "keys", "fp"]
            )

    return docs.select(DID, TKEY, "text").mapInArrow(run, f"{DID} long, {TKEY} long, node long, n long, keys array<long>, fp long")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of nodes (u, v) with equal or linked fingerprints; of the nodes of one fingerprint the smallest stands for all."""
    own = rows.select("fp", "node").distinct()
    low = stash(own.groupBy("fp").agg(F.min("node").alias("lo")))
    equal = own.join(low, "fp").select(F.col("lo").alias("u"), F.col("node").alias("v"))
    linked = simhash.links(low.select("fp"))
    for c in "uv":
        linked = linked.join(low.select(F.col("fp").alias(c), F.col("lo").alias(f"lo_{c}")), c)
    linked = linked.select(F.least("lo_u", "lo_v").alias("u"), F.greatest("lo_u", "lo_v").alias("v"))
    return equal.unionByName(linked).filter("u <> v").distinct()


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node and its whole set, for ``rows`` (node, _did, _tk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t).view(np.int64) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return docs.join(joinable(rows), [DID, TKEY]).select("node", "text").mapInArrow(run, "node long, s array<long>")


def _possible(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles that share that many keys can be similar: the rest of their overlap lies behind the keys."""
    overlap = F.ceil(4 * (n + m) / 9 - 1e-6)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (shared >= overlap - F.ceil(4 * F.greatest(n, m) / 5 - 1e-6) + 1)


def _verified(pairs: DataFrame, own: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) with a similarity of at least 0.8."""
    pairs = stash(pairs)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first = rows.select("node", DID, TKEY).join(joinable(nodes), "node", "left_semi").groupBy("node").agg(F.min(F.struct(DID, TKEY)).alias("r"))
    sets = stash(_sets(own, first.select("node", f"r.{DID}", f"r.{TKEY}")))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _candidates(hot: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Pairs of nodes in different components that can be similar by their sizes and shared keys."""
    own = hot.join(roots.select(F.col("node"), "root"), "node", "left").select("k", "node", "n", F.coalesce("root", "node").alias("c"))
    own = stash(own)
    mixed = own.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    mixed = stash(mixed.select("k", F.ceil(F.col("m") / block).cast("int").alias("b")))
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("b")).cast("int")
    dealt = own.join(joinable(mixed), "k").select("k", "node", "n", "c", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    dealt = dealt.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("other")
    a, b = (dealt.select("k", "x", "y", *[F.col(c).alias(f"{c}_{i}") for c in ("node", "n", "c", "mine")]) for i in "uv")
    met = a.join(b, ["k", "x", "y"]).filter("node_u < node_v and c_u <> c_v and (x = y or mine_u <> mine_v) and 5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)")
    shared = met.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v")).agg(F.count("*").alias("shared"), F.first("n_u").alias("n_u"), F.first("n_v").alias("n_v"))
    return shared.filter(_possible(F.col("shared"), F.col("n_u"), F.col("n_v"))).select("u", "v")


def links(own: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose components are those of all similar pairs; ``rows`` are those of _keyed, ``own`` their documents."""
    keyed = rows.select("node", "n", F.explode("keys").alias("k"))
    many = keyed.groupBy("k").agg(F.min(F.struct("node", "n")).alias("lo"), F.max("node").alias("hi")).filter("lo.node <> hi")
    many = stash(many.select("k", F.col("lo.node").alias("lo"), F.col("lo.n").alias("m")))
    hot = stash(keyed.join(joinable(many), "k").select("k", "lo", "m", "node", "n").distinct())
    stars = hot.filter("node <> lo").groupBy("lo", "node").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    stars = stars.filter(_possible(F.col("shared"), F.col("n"), F.col("m"))).groupBy("node").agg(F.slice(F.array_sort(F.collect_set("lo")), 1, STARS).alias("lo"))
    pairs = stars.select(F.explode("lo").alias("u"), F.col("node").alias("v")).unionByName(fingerprint_pairs(rows)).distinct()
    near = stash(_verified(pairs, own, rows))
    more = stash(_verified(_candidates(hot, components(near), block), own, rows))
    return near.unionByName(more)


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The first row (smallest doc_id) of each component of similar rows; of repeated rows one."""
    own = identified(docs)
    rows = stash(_keyed(own, _frequent(own)))
    roots = components(links(own, rows, block))
    nodes = rows.groupBy("node").agg(F.min(F.struct(DID, TKEY)).alias("row"))
    named = stash(nodes.join(roots, "node", "left").select("node", "row", F.coalesce("root", "node").alias("root")))
    linked = named.join(named.filter("node <> root").select("root").distinct(), "root", "left_semi")
    whole = linked.groupBy("root").agg(F.min("row").alias("first"))
    first = named.join(whole, "root", "left").select("node", F.coalesce("first", "row").alias("first"))
    found = rows.select(DID, TKEY, "node").join(first, "node")
    gone = found.filter(F.struct(DID, TKEY) != F.col("first")).select(DID, TKEY).distinct()
    return one_each(without(docs, gone), rows)


def brute(rows: list[tuple[int, str | None]]) -> set[int]:
    """The doc_ids that stay, by comparing all pairs, for tests (distinct doc_ids)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return set(low.values())
