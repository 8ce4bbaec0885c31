"""Periodic runs of words, by extension queries on recompressed texts.

A run is a maximal stretch of words with smallest period q, at least max(LEAST, POWER * q) words long.  Whatever run there is with
period q, it holds POWER neighbouring points of the grid 0, q, 2q, …, with equal words, so only such places are candidates; over all periods the
grids have about n ln n points.  A candidate inside a run that is known already (of a smaller period or the same) is a part of it;
of any other the exact ends come from two extension queries, on the run-length grammar of the texts and on that of the reversed texts
(``recompress``).  Texts are worked on in bundles, as one sequence with a mark of its own behind each text that nothing equals; grammars are
built over the texts with a candidate only.

Defined results: null and empty texts have no words and no run, and their hash is that of no bytes; texts of any length are taken whole; of equally
long runs the one that starts first (then that of the smaller period) is told; repeated rows get equal results, rows are judged one by one; a null
doc_id is passed through (its texts aren't made periodic by op11); an empty table gives an empty one; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .recompress import Grammar

LEAST, POWER = 6, 4
#: Words of a bundle (a longer text is a bundle by itself).
BUNDLE = 200_000
SCHEMA = "doc_id long, n_words long, text string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _grid(sequence: np.ndarray, period: int, power: int) -> np.ndarray:
    """Grid points from which ``power`` points on have equal elements."""
    points = sequence[::period]
    same = points[1:] == points[:-1]
    every = same[: len(same) - power + 2].copy()
    for k in range(1, power - 1):
        every &= same[k : len(same) - power + 2 + k]
    return np.flatnonzero(every) * period


def _periods(sizes: np.ndarray, power: int) -> range:
    return range(1, int(sizes.max(initial=0)) // power + 1)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sequence with a mark behind each text, the texts' places and their sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(at[-1], np.int64)
    for k, t in enumerate(texts):
        out[at[k] : at[k + 1] - 1] = t
        out[at[k + 1] - 1] = -1 - k
    return out, at[:-1], sizes


def runs(texts: list[np.ndarray], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text (arrays of word numbers, from 0), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    whole, at, sizes = _joined(texts)
    hot = np.zeros(len(texts), bool)
    for p in _periods(sizes, power):
        places = _grid(whole, p, power)
        hot[np.searchsorted(at, places, side="right") - 1] = True
    chosen = np.flatnonzero(hot)
    if not len(chosen):
        return found
    whole, at, sizes = _joined([texts[k] for k in chosen])
    n = len(whole)
    ahead, behind = Grammar(whole), Grammar(whole[::-1])
    reach = np.zeros(n, np.int64)  # how far the known runs go that hold a place
    for p in _periods(sizes, power):
        span = (power - 1) * p
        places = _grid(whole, p, power)
        for i in places[reach[places] <= places + span].tolist():
            if reach[i] > i + span:
                continue
            end = i + p + ahead.extension(i, i + p)
            if end - i < span:
                continue
            start = i - (behind.extension(n - i - p, n - i) if i else 0)
            if end - start >= max(least, power * p):
                reach[start:end] = np.maximum(reach[start:end], end)
                k = int(np.searchsorted(at, start, side="right")) - 1
                found[chosen[k]].append((int(start - at[k]), int(end - start), p))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def kept(n: int, of: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in of:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where op11's contract makes a text periodic, the place of the original word for each word."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def detect(docs: DataFrame, least: int = LEAST, power: int = POWER, planted: bool = False, texts: bool = True) -> DataFrame:
    """doc_id, n_words, text, runs (start, length, period in words) and ``collapsed``, the text that is left, words joined by one blank.

    ``planted`` first makes a tenth of the texts periodic, by op11's contract.  Without ``texts`` the two texts are digests: ``collapsed`` is a
    sha256 and ``text`` is null.
    """

    def bundle(rows: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
        codes, _ = pd.factorize(np.array([w for _, words in rows for w in words], object))
        ends = np.cumsum([len(words) for _, words in rows])
        arrays = np.split(codes.astype(np.int64), ends[:-1])
        out = []
        for (doc_id, words), of in zip(rows, runs(arrays, least, power), strict=True):
            left = words
            if of:
                left = [words[k] for k in np.flatnonzero(kept(len(words), of))]
            body = b" ".join(left)
            said = [dict(zip(("start", "length", "period"), r, strict=True)) for r in of]
            out.append((len(words), b" ".join(words).decode() if texts else None, said, body.decode() if texts else hashlib.sha256(body).hexdigest()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            words = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]  # bytes are split at ASCII's blanks alone
            if planted:
                for k, doc_id in enumerate(ids):
                    at = _made_periodic(doc_id, len(words[k]))
                    if at is not None:
                        words[k] = [words[k][i] for i in at.tolist()]
            done: list[tuple] = [()] * len(ids)
            held: list[int] = []
            size = 0
            for k in sorted(range(len(ids)), key=lambda k: len(words[k])):  # long texts, which have more periods, together
                if held and size + len(words[k]) > BUNDLE:
                    for i, x in zip(held, bundle([(ids[i], words[i]) for i in held]), strict=True):
                        done[i] = x
                    held, size = [], 0
                held.append(k)
                size += len(words[k])
            if held:
                for i, x in zip(held, bundle([(ids[i], words[i]) for i in held]), strict=True):
                    done[i] = x
            columns = list(zip(*done, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), _RUN, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "text", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``detect`` on the texts as they are: every run, and the texts with one period of each."""
    return detect(docs, least, power)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``detect`` over the whole ``documents`` table, a tenth of it made periodic by the contract."""
    out = detect(table(spark, sf_dir, "documents"), planted=True, texts=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def brute(words: list[str], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """The runs by plain loops, for tests."""
    n, out = len(words), []
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, power * p):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))
