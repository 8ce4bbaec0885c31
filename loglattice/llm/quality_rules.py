"""Quality rules in DataFrame operations only: base counts and a hashed n-gram log-likelihood ratio.

Every document's word and sign runs give hashed 1- and 2-grams.  Their bucket counts over the trusted target
(documents whose ``labels.quality`` is 1) and over the raw corpus (all documents) make two multinomials; a
document's score is its mean log ratio ``log p_target / p_raw`` per n-gram, and it is kept when the score
reaches a fixed threshold.  Counts cover all documents; the model has a fixed size (BUCKETS numbers).

Defined results: null or empty text has no words, so it fails the base rules; a null ``doc_id`` has no label; a
doc_id that the labels name more than once with quality 1 counts once; without labels both multinomials agree and
the base rules decide alone; repeated rows count as often as they occur; texts of one doc_id share its label; texts of any length are taken whole;
a score at the threshold is kept; an empty table gives an empty one; other columns may have any names and stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stash, table

BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.4
BITMAP_BYTES = 64 << 20
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Runs of letters and digits (all beyond ASCII counts as letters), or runs of other signs.
_GRAMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(tokens: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``size`` words whose word sequence occurs at least twice in ``tokens``.

    Windows are hashed; if two hashes agree, the sorted hashes tell which occur twice.  Of a few such hashes every
    window is looked up; of many, windows are sorted with their places.
    """
    zero = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        """Words under windows that begin at the sorted ``starts``: each covers ``size``, or as far as the next start."""
        gap = lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(size)), F.lit(size))
        return F.aggregate(F.transform(starts, gap), zero, lambda a, v: a + v)

    def few(hashes: Column, twice: Column) -> Column:
        found = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i))
        return let(F.filter(found, lambda i: i.isNotNull()), covered)

    def many(hashes: Column) -> Column:
        def starts(o: Column) -> Column:
            again = lambda x, i: ((i > 0) & (x["h"] == F.get(o, i - 1)["h"])) | (x["h"] == F.get(o, i + 1)["h"])
            places = F.filter(F.transform(o, lambda x, i: F.when(again(x, i), x["i"])), lambda i: i.isNotNull())
            return let(F.sort_array(places), covered)

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts)

    def count(hashes: Column) -> Column:
        twice = lambda o: F.array_distinct(F.filter(o, lambda x, i: x == F.get(o, i + 1)))
        choose = lambda t: F.when(F.size(t) <= 24, few(hashes, t)).otherwise(many(hashes))
        again = let(F.sort_array(hashes), lambda o: let(twice(o), choose))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(again)

    windows = lambda w: F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size)))), 1, F.size(w) - (size - 1)
    )
    return F.when(F.size(tokens) < size, zero).otherwise(let(windows(tokens), count))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; needs text and none of these names."""
    t = _text()
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns(
        {
            "_counts": let(
                words(t),
                lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r")),
            ),
            "n_symbols": (F.octet_length(t) - F.octet_length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.col("_counts.n"), "word_chars": F.col("_counts.c"), "n_repeat_words": F.col("_counts.r")}).drop("_counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_GRAMS), F.lit(0))


def _bucket(hashed: Column, buckets: int) -> Column:
    return hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")  # buckets is a power of two


def _buckets(tokens: Column, buckets: int) -> Column:
    """Bucket numbers of the 1- and 2-grams of an array of tokens (the last token's pair is with nothing)."""
    one = F.transform(tokens, lambda w: _bucket(F.xxhash64(w), buckets))
    two = F.transform(tokens, lambda w, i: _bucket(F.xxhash64(w, F.get(tokens, i + 1)), buckets))
    return F.concat(one, two)


def _trusted(docs: DataFrame, labels: DataFrame, limit: int = BITMAP_BYTES) -> DataFrame:
    """``docs`` with t, 1 for a trusted doc_id, else 0.

    The ids go to the workers as bitmaps of 4 KB for 32,768 numbers in a row, so texts aren't shuffled.  Ids so scattered that their
    bitmaps take more than ``limit`` bytes meet the documents in a shuffled join.
    """
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    part = F.call_function("bitmap_bucket_number", F.col("doc_id").cast("long"))
    bits = stash(ids.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(F.call_function("bitmap_bit_position", F.col("doc_id"))).alias("bits")))
    if bits.count() * 4096 > limit:
        marked = docs.withColumn("id", F.col("doc_id").cast("long")).join(ids.distinct().select(F.col("doc_id").alias("id"), F.lit(1).alias("t")), "id", "left")
        return marked.select(*docs.columns, F.coalesce("t", F.lit(0)).alias("t"))
    joined = docs.withColumn("part", part).join(F.broadcast(bits), "part", "left")
    at = F.call_function("bitmap_bit_position", F.col("doc_id").cast("long"))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1))
    return joined.select(*docs.columns, F.coalesce(bit, F.lit(0)).cast("int").alias("t"))


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, limit: int = BITMAP_BYTES) -> list[float]:
    """log p_target(bucket) / p_raw(bucket) for every bucket; the counts are summed on the cluster."""
    rows = _trusted(docs.select("doc_id", _text().alias("text")), labels, limit)
    grams = rows.select("t", F.explode(let(_tokens(F.col("text")), lambda t: _buckets(t, buckets))).alias("b"))
    got = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # at most BUCKETS rows
    raw, target = [smoothing] * buckets, [smoothing] * buckets
    for r in got:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    return _log_ratios(target, raw, sum(r["target"] for r in got))


def _log_ratios(target: list[float], raw: list[float], found: int) -> list[float]:
    if not found:
        return [0.0] * len(raw)
    a, b = math.fsum(target), math.fsum(raw)
    return [round(math.log(x / a) - math.log(y / b), 9) for x, y in zip(target, raw, strict=True)]


def llr(text: Column, ratio: list[float]) -> Column:
    """Mean log ratio per n-gram; 0 for a text without n-grams."""
    model = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded into one constant
    at = lambda h: F.get(model, _bucket(h, len(ratio)))
    pair = lambda t: F.transform(t, lambda w, i: at(F.xxhash64(w)) + at(F.xxhash64(w, F.get(t, i + 1))))
    total = lambda t: F.aggregate(pair(t), F.lit(0.0), lambda a, x: a + x) / F.greatest(2 * F.size(t), F.lit(1))
    return let(_tokens(text), total)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each whole row of ``docs`` as the struct ``row``, with the base columns, ``llr`` and ``kept``."""
    ratio = ratios(docs, labels)
    out = base_counts(docs.select(F.struct("*").alias("row"), _text().alias("text"))).withColumn("llr", llr(_text(), ratio))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("text")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of ``documents``."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def brute_base(text: str | None) -> tuple:
    """The base columns by plain loops, for tests."""
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def brute_llr(rows: list[tuple], trusted: set, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Scores by plain loops, for tests: rows (doc_id, text)."""
    import xxhash

    def grams(text: str | None) -> list[int]:
        w, out = [x.encode() for x in re.findall(_GRAMS, text or "")], []
        for i, x in enumerate(w):
            one = xxhash.xxh64_intdigest(x, 42)
            out += [one & (buckets - 1), (xxhash.xxh64_intdigest(w[i + 1], one) if i + 1 < len(w) else one) & (buckets - 1)]
        return out

    every = [grams(t) for _, t in rows]
    target, raw = [smoothing] * buckets, [smoothing] * buckets
    for (d, _), g in zip(rows, every, strict=True):
        for b in g:
            raw[b] += 1
            target[b] += d in trusted
    ratio = _log_ratios(target, raw, sum(len(g) for (d, _), g in zip(rows, every, strict=True) if d in trusted))
    return [sum(ratio[b] for b in g) / max(len(g), 1) for g in every]
