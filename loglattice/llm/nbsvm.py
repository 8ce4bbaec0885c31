"""Quality classifier: a naive Bayes support vector machine.

Binary indicators of hashed word n-grams are scaled by the classes' log-count ratio; a linear hinge-loss model
is fitted to them by dual coordinate descent.  Labels come from a bounded sample (SAMPLE rows with the smallest
hash of doc_id, of the rows that may be learned from); only the sample's hashed features reach the driver.  Scoring
covers every whole text; the model has a fixed size (DIMS weights).

Words are runs of letters and digits or runs of other signs; case shapes are features too.  Defined results:
null or empty text has no n-gram and gets the score of the bias; a null doc_id is never learned from and isn't
held out (crc32 of a null is null); several different labels of one doc_id count as rows of their own, and so do
several texts of one; repeated rows are learned from once, score alike, and the bound holds for rows of text; long texts are scored whole; of equal
hashes the smaller doc_id is taken; an empty table gives an empty one; other columns may have any names; without usable
labels (or with one class only) every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DID, TKEY, identified, table

DIMS = 1 << 18
SAMPLE, EPOCHS, COST, ALPHA = 8000, 12, 0.1, 1.0
FOLDS, THRESHOLD = 5, 0.3
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def _shape(word: str) -> str:
    if not word.isalpha():
        return "9" if word.isalnum() else word[:3]
    return "A" if len(word) > 1 and word.isupper() else "Aa" if word[0].isupper() else "a"


def features(text: str, known: dict) -> np.ndarray:
    """Distinct hashed features: words, pairs of words, pairs of shapes, and coarse shares of signs and repetition."""
    words = _TOKENS.findall(text)
    if not words:
        return np.zeros(0, np.int32)
    if len(known) > 400_000:
        known.clear()
    codes = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = (xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(_shape(w), 7))
        codes.append(c)
    pair = np.array(codes, np.uint64)
    word, shape = np.unique(pair[:, 0]), pair[:, 1]
    both = pair[:-1, 0] * np.uint64(0x9E3779B97F4A7C15) + pair[1:, 0]
    shapes = np.unique(shape[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + shape[1:])
    same = int(20 * (1 - len(word) / len(words)))
    signs = int(10 * sum(not w[0].isalnum() for w in words) / len(words))
    coarse = np.array([xxhash.xxh3_64_intdigest(x) for x in (f"same{same}", f"signs{signs}")], np.uint64)
    every = np.concatenate((word, both, shapes, coarse))
    return np.unique((every ^ (every >> np.uint64(29))) % np.uint64(DIMS)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST, alpha: float = ALPHA) -> tuple[np.ndarray, float, float, float, np.ndarray]:
    """Weights, bias, the slope and shift that turn a margin into a probability, and the log-count ratios."""
    weights = np.zeros(DIMS)
    n, ones = len(rows), int(labels.sum()) if len(rows) else 0
    if ones in (0, n):
        share = ones / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return weights, 0.0, 1.0, float(np.log(share / (1 - share))), np.zeros(DIMS)
    count = np.full((2, DIMS), alpha)
    for r, y in zip(rows, labels, strict=True):
        count[int(y), r] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    values = [ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) + 1e-9) for r in rows]  # unit length: long texts weigh no more
    sign = np.where(labels == 1, 1.0, -1.0)
    box = cost * n / np.where(labels == 1, 2 * ones, 2 * (n - ones)) * 10
    dual, bias = np.zeros(n), 0.0
    rng = np.random.default_rng(5)
    for _ in range(epochs):  # L1-loss dual: one coordinate at a time, clipped to its box
        for i in rng.permutation(n):
            r, v = rows[i], values[i]
            gradient = sign[i] * (weights[r] @ v + bias) - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), box[i])  # |x|^2 = 1, and 1 for the bias
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weights[r] += step * v
                bias += step
                dual[i] = new
    margin = np.array([weights[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, shift = 1.0, 0.0
    for _ in range(200):  # logistic calibration
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        w, e = p * (1 - p) + 1e-6, labels - p
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        d = np.linalg.solve(h, [(e * margin).sum() - 1e-3 * slope, e.sum()])
        slope, shift = slope + d[0], shift + d[1]
        if abs(d).max() < 1e-6:
            break
    model = weights * ratio
    return model, float(bias), float(slope), float(shift), ratio


def _fold(column: str) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("quality").isin(0, 1) & (_fold("doc_id") != 0)).select(F.col("doc_id").cast("long").alias(DID), F.col("quality").cast("int").alias("y"))
    chosen = usable.distinct().orderBy(F.xxhash64(DID), DID, "y").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            rows = [features(t, known).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(DID), b.column(TKEY), b.column("y"), pa.array(rows, pa.binary())], [DID, TKEY, "y", "x"])

    texts = docs.join(F.broadcast(chosen), DID).dropDuplicates([DID, TKEY, "y"])
    picked = texts.select(DID, TKEY, "y", "text").mapInArrow(run, f"{DID} long, {TKEY} long, y int, x binary")
    got = sorted((d, y, x) for d, _, y, x in picked.orderBy(F.xxhash64(DID, TKEY), DID, TKEY, "y").limit(sample).collect())
    return fit([np.frombuffer(x, np.int32) for _, _, x in got], np.array([y for _, y, _ in got], float))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row."""
    weights, bias, slope, shift, ratio = model
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), ratio.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, r = sent.value
        known: dict = {}
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                x = features(t, known)
                length = float(np.sqrt((r[x].astype(np.float64) ** 2).sum())) + 1e-9
                margin = float(w[x].sum(dtype=np.float64)) / length + bias
                out.append(1 / (1 + np.exp(-min(max(slope * margin + shift, -50), 50))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    docs = identified(table(spark, sf_dir, "documents"))
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
