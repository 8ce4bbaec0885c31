"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are lower-cased runs.  A benchmark window is 13 consecutive words of an item (a shorter item is one window).

1. Winnow: every k-gram of words is hashed; of each run of ``13 - k + 1`` hashes the smallest (leftmost on ties)
   is kept with its place.  Two equal windows keep the same relative place, so every shared window shares a
   fingerprint.  Items shorter than a window are fingerprinted whole, and documents by all grams of those lengths.
2. Join fingerprints of documents and items: a document's fingerprint that any item has is a seed, once, wherever items have it.
3. Extend: every window of the document around a seed is compared, word for word, with the distinct windows of the items.

A document costs as many rows as it has windows around seeds, also where text and items repeat themselves.  The benchmark's
fingerprints, windows and the seeds are broadcast only if their counted size is small; else the joins are shuffled.
Defined results: null or empty text has no words (n_words 0, not contaminated); items without words are ignored; a
null item_id never counts as an item but its windows do hit; repeated rows get equal results; a null doc_id is kept; texts of
one doc_id are told apart; ties between equal hashes go to the leftmost; empty tables give empty results (no benchmark: no hits);
columns other than doc_id, text and item_id may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DID, TKEY, carried, identified, joinable, let, stash, table

WINDOW, GRAM = 13, 6
#: Bytes of item windows and number of seeds up to which they are broadcast.
BROADCAST_BYTES, BROADCAST_SEEDS = 64 << 20, 1_000_000
#: ASCII signs that part words, once A-Z are lower-cased or counted as letters.
_SIGNS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """The words in their own case."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SIGNS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def words(text: Column) -> Column:
    return _split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER))


def _codes(tokens: Column) -> Column:
    """A hash for each word.  ``lower`` folds more than A-Z, so that equal words still agree; hits are confirmed later."""
    return F.transform(tokens, lambda w: F.xxhash64(F.lower(w)))


def _grams(codes: Column, size: int) -> Column:
    """Hashes of all grams of ``size`` words; needs at least that many."""
    hashed = F.transform(codes, lambda c, i: F.xxhash64(c, *(F.get(codes, i + k) for k in range(1, size))))
    return F.slice(hashed, 1, F.size(codes) - (size - 1))


def _none() -> Column:
    return F.array().cast("array<struct<h:bigint,p:int>>")


def winnow(codes: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """array<struct<h,p>>: kept gram hashes (40 bits) and their places (from 0); empty if shorter than a window.

    Each gram's hash carries its place in its low 24 bits, so the smallest of a run is found by repeated pairwise minima;
    a kept gram's place follows from the run's, also beyond 2**24 words.
    """
    run = window - gram + 1

    def pack(g: Column) -> Column:
        return F.transform(g, lambda h, i: h.bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(i.bitwiseAND(F.lit((1 << 24) - 1)).cast("long")))

    def low(v: Column, reach: int) -> Column:
        if reach == run:
            return let(v, kept)
        step = min(reach, run - reach)
        return let(F.transform(v, lambda x, i: F.least(x, F.get(v, i + step))), lambda m: low(m, reach + step))

    def kept(m: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            place = (i + F.pmod(x - i, F.lit(1 << 24))).cast("int")
            new = (i == 0) | (x != F.get(m, i - 1))
            return F.when(new, F.struct(F.shiftright(x, 24).alias("h"), place.alias("p")))

        return F.filter(F.slice(F.transform(m, mark), 1, F.size(m) - (run - 1)), lambda s: s.isNotNull())

    return F.when(F.size(codes) < window, _none()).otherwise(let(pack(_grams(codes, gram)), lambda v: low(v, 1)))


def _every(codes: Column, size: int) -> Column:
    """array<struct<h,p>> of all grams of ``size`` words (for items shorter than a window)."""
    marked = lambda g: F.transform(g, lambda h, i: F.struct(F.xxhash64(F.lit(size), h).alias("h"), i.alias("p")))
    return F.when(F.size(codes) < size, _none()).otherwise(let(_grams(codes, size), marked))


def _short_key(tokens: Column) -> Column:
    """The key that ``_every`` gives a gram equal to the whole of a short item."""
    n = F.size(tokens)
    whole = F.lit(None).cast("bigint")
    for size in range(WINDOW - 1, 0, -1):
        whole = F.when(n == size, F.xxhash64(F.lit(size), F.xxhash64(*(F.xxhash64(F.lower(F.get(tokens, F.lit(k)))) for k in range(size))))).otherwise(whole)
    return whole


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id, words and fingerprints of every item with words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    short = F.transform(F.array(_short_key(F.col("words"))), lambda h: F.struct(h.alias("h"), F.lit(0).alias("p")))
    return items.withColumn("fps", F.when(n < window, short).otherwise(let(_codes(F.col("words")), lambda c: winnow(c, window, gram))))


def _windows(words: Column, size: Column, start: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def item_pool(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: wid, text and ids of the items that have it (without null)."""
    size = F.least(F.size("words"), F.lit(window))
    every = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda j: _windows(F.col("words"), size, j))).alias("window"))
    return every.groupBy("window").agg(F.collect_set("item_id").alias("ids")).withColumn("wid", F.monotonically_increasing_id())


def _starts(seeds: Column, n: Column, window: int, gram: int) -> Column:
    """array<struct<size,start>>: the windows of a text of ``n`` words around its sorted seeds (size, p), each once."""

    def around(x: Column, i: Column) -> Column:
        before = F.get(seeds, i - 1)
        new = F.when((i > 0) & (before["size"] == x["size"]), before["p"] + 1).otherwise(0)
        low, high = F.greatest(x["p"] - (window - gram), new), F.least(x["p"], n - window)
        many = F.when(low <= high, F.transform(F.sequence(low, high), lambda s: F.struct(x["size"].alias("size"), s.alias("start"))))
        one = F.array(F.struct(x["size"].alias("size"), x["p"].alias("start")))
        return F.when(x["size"] < window, one).otherwise(F.coalesce(many, F.array().cast("array<struct<size:int,start:int>>")))

    return F.flatten(F.transform(seeds, around))


def _places(spans: Column) -> Column:
    """The words under sorted windows (size, start), each once."""

    def fresh(x: Column, i: Column) -> Column:
        after = F.get(spans, i + 1)
        end = x["start"] + x["size"]
        return F.sequence(x["start"], F.when(after["size"] == x["size"], F.least(end, after["start"])).otherwise(end) - 1)

    return F.array_distinct(F.flatten(F.transform(spans, fresh)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_did, _tk, doc_id, n_words, hit (places of hit words) and items (ids with occurring windows) of every document."""
    own = identified(docs)
    items = item_windows(benchmark, window, gram)
    lengths = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words") < window).distinct().collect())  # at most window - 1
    sized = lambda fps, size: F.transform(fps, lambda x: F.struct(x["h"].alias("h"), F.lit(size).alias("size"), x["p"].alias("p")))
    prints = joinable(stash(items.select(F.inline("fps")).select("h").distinct()))
    found = own.select(
        DID, TKEY, F.inline(let(_codes(_split(F.col("text"))), lambda c: F.concat(sized(winnow(c, window, gram), window), *(sized(_every(c, n), n) for n in lengths))))
    ).join(prints, "h", "left_semi")
    seeds = stash(found.groupBy(DID, TKEY).agg(F.array_sort(F.collect_set(F.struct("size", "p"))).alias("seeds")))
    many = seeds.agg(F.count("*"), F.sum(F.size("seeds"))).first()
    few = (many[0] + (many[1] or 0)) <= BROADCAST_SEEDS
    marked = identified(docs).drop("doc_id").join(F.broadcast(seeds) if few else seeds, [DID, TKEY])
    tried = marked.select(DID, TKEY, words(F.col("text")).alias("words"), "seeds")
    tried = tried.select(DID, TKEY, F.explode(let(F.col("words"), lambda w: F.transform(_starts(F.col("seeds"), F.size(w), window, gram), lambda x: x.withField("window", _windows(w, x["size"], x["start"]))))).alias("x"))
    pool = stash(item_pool(items, window))
    width = pool.agg(F.sum(F.length("window") + 64)).first()[0] or 0
    texts = pool.select("window", "wid")
    hits = tried.select(DID, TKEY, "x.*").join(F.broadcast(texts) if width <= BROADCAST_BYTES else texts, "window").select(DID, TKEY, "size", "start", "wid").distinct()
    hits = stash(hits)
    spans = hits.groupBy(DID, TKEY).agg(F.array_sort(F.collect_set(F.struct("size", "start"))).alias("spans"))
    ids = hits.select(DID, TKEY, "wid").distinct().join(pool.select("wid", F.explode("ids").alias("item_id")), "wid")
    ids = ids.groupBy(DID, TKEY).agg(F.collect_set("item_id").alias("items"))
    both = stash(spans.select(DID, TKEY, _places(F.col("spans")).alias("hit")).join(ids, [DID, TKEY], "left"))
    told = both.agg(F.count("*"), F.sum(F.size("hit"))).first()
    few = (told[0] + (told[1] or 0)) <= BROADCAST_SEEDS
    counted = own.select(DID, TKEY, "doc_id", F.size(_split(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(F.broadcast(both) if few else both, [DID, TKEY], "left")
    none = {"hit": F.array().cast("array<int>"), "items": F.array().cast(items.select(F.array("item_id").alias("x")).schema["x"].dataType)}
    return out.select(DID, TKEY, "doc_id", "n_words", *[F.coalesce(c, empty).alias(c) for c, empty in none.items()])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every row of ``documents`` by ``benchmark``."""
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that the contract's rule doesn't call contaminated, with their own columns."""
    bad = contamination(docs, benchmark).filter((F.size("hit") > 0) & (20 * F.size("hit") >= F.col("n_words"))).select(DID, TKEY).distinct()
    return carried(docs).join(joinable(stash(bad)), [DID, TKEY], "left_anti").select("row.*")


def brute(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by trying every window, for tests."""
    import hashlib
    import re

    def split(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    pool: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if w else ():
            pool.setdefault(tuple(w[j : j + n]), set()).add(i)
    sizes, out = {len(k) for k in pool}, []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in pool:
                    hit |= set(range(j, j + n))
                    found |= pool[k]
        names = ",".join(sorted(str(i) for i in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
