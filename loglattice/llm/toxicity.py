"""Toxicity by a factorization machine over hashed terms.

A document's features are the terms that it has, lower-cased words hashed into DIMS buckets; how often and where doesn't count, so a remark in
a long text weighs what it weighs in a short one.  The machine scores

    bias + sum of w_i + sum over pairs of <v_i, v_j>

over the terms present: the second sum is what a pair means beyond its terms, such as an insult with the mention of a group, and costs no more
than the first, as it is half of (sum of v_i)^2 less the sum of v_i^2.  Labels come from a bounded sample (SAMPLE rows with the smallest hash of
doc_id, of those that may be learned from; rows with equal texts and labels once).  Evidence by term and class is counted on Spark, once per
neighbourhood (the words before and behind a term's first place in a row), so that near copies of one toxic text don't make all its words suspect; the
TERMS buckets whose evidence differs most between the classes (at least EVIDENCE standard errors, smaller buckets first) are the machine's terms, and only which of them each sampled row has reaches
the driver, so that what it holds is bounded by SAMPLE x TERMS however long texts are.  Weights are fitted to the logistic loss by small-batch steps with penalties, in the first third of the epochs without
pairs.  Every
row is scored, over its whole text.

Defined results: null and empty texts have no terms and get the score of the bias; a null doc_id is never learned from and not held out;
several labels of one doc_id count as rows of their own, several texts of one too (of equal texts with equal labels one is learned from); of equally telling buckets the smaller number comes first; without
usable labels of both classes every score is the share of label 1 (0.5 without labels); repeated rows get equal scores; an empty table gives an empty
one; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DID, TKEY, identified, stash, table

DIMS, TERMS, FACTORS = 1 << 22, 2048, 8
SAMPLE, EPOCHS, BATCH, RATE, EVIDENCE = 12_000, 60, 128, 0.05, 4.0
#: Penalties of linear weights, of factors (a pair should carry only what its terms alone can't) and of the bias, towards the share of label 1 (so
#: that one telling term can outweigh it).
PENALTY, INNER_PENALTY, BIAS_PENALTY = 5e-7, 2e-4, 0.02
FOLDS, THRESHOLD = 5, 0.5
#: Sampled texts whose terms a worker holds at a time.
PART = 200
_WORD = re.compile(r"[^\W_]+")


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % DIMS


def terms(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def placed(text: str) -> list[dict]:
    """Each bucket of the text (t) with a hash of the words around its first place (c)."""
    words = ["", *_WORD.findall(text.lower()), ""]
    out: dict[int, int] = {}
    for k in range(1, len(words) - 1):
        b = bucket(words[k])
        if b not in out:
            out[b] = xxhash.xxh32_intdigest(f"{words[k - 1]} {words[k + 1]}")
    return [{"t": t, "c": c} for t, c in sorted(out.items())]


@dataclass
class Machine:
    buckets: np.ndarray  # of the terms, in the order of the weights
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # terms x FACTORS

    def margin(self, present: np.ndarray) -> float:
        """The score before the logistic function, from the numbers of the terms present."""
        v = self.factors[present]
        return float(self.bias + self.linear[present].sum() + (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum() / 2)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def gradient(machine: Machine, x: np.ndarray, y: np.ndarray, penalty: float, inner_penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss with the penalty, by bias, linear weights and factors; ``x``: rows x terms of 0 and 1."""
    inner = x @ machine.factors
    margin = machine.bias + x @ machine.linear + ((inner**2).sum(axis=1) - (x @ (machine.factors**2)).sum(axis=1)) / 2
    e = (logistic(margin) - y) / len(y)
    linear = x.T @ e + penalty * machine.linear
    factors = x.T @ (e[:, None] * inner) - (x.T @ e)[:, None] * machine.factors + inner_penalty * machine.factors
    return float(e.sum()), linear, factors


def fit(buckets: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY, inner_penalty: float = INNER_PENALTY, factors: int = FACTORS) -> Machine:
    """The machine of ``rows`` (numbers of the terms present) and ``labels`` (0 or 1)."""
    rng = np.random.default_rng(13)
    n, ones = len(rows), float(np.sum(labels))
    share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
    out = Machine(buckets, float(np.log(share / (1 - share))), np.zeros(len(buckets)), np.zeros((len(buckets), factors)))
    if ones in (0, n) or not len(buckets):
        return out
    start = out.bias
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), out.linear, out.factors)]
    step = 0
    for epoch in range(epochs):
        if epoch == epochs // 3:
            out.factors[:] = rng.normal(0, 0.05, out.factors.shape)
        order = rng.permutation(n)
        rate = RATE * (1 - epoch / epochs)
        for low in range(0, n, BATCH):
            part = order[low : low + BATCH]
            x = np.zeros((len(part), len(buckets)))
            for k, i in enumerate(part):
                x[k, rows[i]] = 1.0
            bias, linear, inner = gradient(out, x, labels[part], penalty, inner_penalty)
            bias += BIAS_PENALTY * (out.bias - start)
            step += 1
            for w, g, (m, s) in zip((None, out.linear, out.factors), (np.array([bias]), linear, inner), moments, strict=True):
                m[:], s[:] = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if w is None:
                    out.bias -= float(move[0])
                else:
                    w -= move
    return out


def _fold(column: str) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def telling(rows: DataFrame, count: int, evidence: float) -> list[int]:
    """The ``count`` buckets whose share of rows differs most between the classes of ``rows`` (y, x), the most telling first."""
    n1, n0 = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first() or (0, 0)
    if not n1 or not n0:
        return []
    around = rows.select("y", F.explode("x").alias("x")).groupBy("x.t", "x.c", "y").count()
    seen = around.groupBy(F.col("t").alias("term")).agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    lead = F.log(a / (n1 + 1.0)) - F.log(b / (n0 + 1.0))
    error = F.abs(lead) / F.sqrt(1 / a + 1 / b)
    best = seen.select("term", error.alias("z")).filter(F.col("z") >= evidence).orderBy(F.desc("z"), "term").limit(count)
    return [r[0] for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, count: int = TERMS, evidence: float = EVIDENCE) -> Machine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; ``docs`` as ``common.identified``."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & (_fold("doc_id") != 0)).select(F.col("doc_id").cast("long").alias(DID), F.col("toxic").cast("int").alias("y")).distinct()
    chosen = usable.orderBy(F.xxhash64(DID), DID, "y").limit(sample)
    texts = docs.join(F.broadcast(chosen), DID).dropDuplicates([TKEY, "y"]).orderBy(TKEY, "y").limit(sample).select(TKEY, "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = pa.list_(pa.struct([("t", pa.int64()), ("c", pa.int64())]))
            for low in range(0, b.num_rows, PART):  # what a worker holds as Python objects
                part = b.slice(low, PART)
                found = [placed(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(TKEY), part.column("y"), pa.array(found, kind)], [TKEY, "y", "x"])

    rows = stash(texts.mapInArrow(run, f"{TKEY} long, y int, x array<struct<t:long,c:long>>"))
    buckets = telling(rows, count, evidence)
    place = {t: k for k, t in enumerate(buckets)}
    held = rows.select(TKEY, "y", F.array_intersect("x.t", F.array(*map(F.lit, buckets)) if buckets else F.array().cast("array<long>")).alias("x"))
    got = sorted(tuple(r) for r in held.collect())
    return fit(np.array(buckets, np.int64), [np.array([place[t] for t in x], int) for *_, x in got], np.array([y for _, y, _ in got], float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = {int(t): k for k, t in enumerate(m.buckets)}
        known: dict[str, int] = {}  # a word's term, -1 if it is none
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                present = set()
                for w in terms(t):
                    k = known.get(w)
                    if k is None:
                        if len(known) > 400_000:
                            known.clear()
                        k = known[w] = place.get(bucket(w), -1)
                    if k >= 0:
                        present.add(k)
                out.append(float(logistic(m.margin(np.fromiter(sorted(present), int, len(present))))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    docs = identified(table(spark, sf_dir, "documents"))
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
