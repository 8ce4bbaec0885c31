"""Secret scans by a linear-chain conditional random field, beside fixed base patterns.

A document is a chain of tokens.  Each token is tagged begin, inside or outside of a secret from: its shape class, the
classes of the two neighbours on either side, and a feature of the file (how many of its tokens look like code).  The
weights are fitted by gradient steps on exact forward-backward likelihood; the labels are the base patterns' matches in a
bounded sample (SAMPLE rows and of their stretches 2 x CHAINS, those with the smallest hashes), so the model carries their contexts over to
other values.  LEAST is the shortest code-like token that a tagged span may begin or end with.
Viterbi decodes whole chains: a token whose lead for "outside" exceeds what all transitions could win back is outside on
every best path, so the chain may be cut there without changing the result, and most text is decided at once.

Defined results: null text is empty (no span); a sample without secrets gives a model that adds nothing; repeated rows get
equal results; long texts are decoded whole; tagged spans that touch a base span are not added again; equally good paths: the lower tag; texts
of one doc_id are told apart; a null doc_id is scanned like any other; an empty table gives an empty one; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DID, TKEY, identified, stash, table

SAMPLE, CHAINS, STEPS, LEAST = 3000, 2000, 60, 8
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")  # runs are maximal: bounds drop short ones
#: Tokens: runs without blanks, quotes, brackets and separators; quotes, colons and equals signs by themselves.
_TOKEN = re.compile(r"[^\s\"':,;<>(){}\[\]|=]+|[\"':=]")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINT = re.compile(r"pass|pwd|secret|token|key|cred|auth|bearer", re.I)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, by start, then kind."""
    low, out = text.lower(), []
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> tuple:
    """The token's class."""
    n = len(token)
    if n == 1 and token in "\"':=":
        return ("sign", token in ":=")
    if _HINT.search(token):
        return ("hint",)
    bare = "".join(c for c in token if c.isalnum())
    if not bare:
        return ("sign", "other")
    digits = sum(c.isdigit() for c in bare)
    if not digits:
        return ("word", min(len(bare) // 8, 3), bare[1:] != bare[1:].lower() and not bare.isupper())
    letters = len(bare) - digits
    mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(bare, bare[1:], strict=False))
    return ("code", min(n // 6, 6), letters == 0, min(mixed, 6) if letters else 0, bare != bare.lower(), bare.upper() != bare)


def tokens(text: str, known: dict) -> list[tuple]:
    classes = []
    for t in _TOKEN.findall(text):
        c = known.get(t)
        if c is None:
            if len(known) > 400_000:
                known.clear()
            c = known[t] = shape(t)
        classes.append(c)
    return classes


def _file(classes: list[tuple]) -> int:
    return min(sum(c[0] in ("code", "hint") for c in classes) * 20 // max(len(classes), 1), 3)


class Model:
    """Emission tables by class for five places around a token, a table by file feature, and transitions (O, B, I)."""

    PLACES = (-2, -1, 0, 1, 2)

    def __init__(self, classes: list[tuple]) -> None:
        self.index = {c: i + 2 for i, c in enumerate(classes)}  # 0: beyond the text, 1: a class never seen
        self.emit = np.zeros((len(self.PLACES), len(classes) + 2, 3))
        self.file, self.trans = np.zeros((4, 3)), np.zeros((3, 3))
        self.trans[0, 2] = -8.0  # inside can't follow outside

    def decode(self, chains: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
        """Tags (0 outside, 1 begin, 2 inside) of the best path of every chain (class ids, file feature), in lockstep."""
        edge = np.zeros(2, np.int64)
        padded = np.concatenate([x for ids, _ in chains for x in (ids, edge)] + [edge])
        sizes = np.array([len(ids) for ids, _ in chains])
        ends = np.cumsum(sizes + 2)
        padded = np.concatenate((edge, padded))
        inner = np.concatenate([np.arange(e - 2 - n, e - 2) for e, n in zip(ends, sizes, strict=True)]) + 2
        e = np.repeat(self.file[[f for _, f in chains]], sizes, axis=0)
        for p, off in enumerate(self.PLACES):
            e += self.emit[p][padded[inner + off]]
        tags = np.zeros(len(e), np.int64)
        lead = max(self.trans[p, y] + self.trans[y, q] - self.trans[p, 0] - self.trans[0, q] for p in range(3) for y in (1, 2) for q in range(3))
        doubt = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= lead + 1e-6)
        if len(doubt):
            chain = np.repeat(np.arange(len(sizes)), sizes)
            cut = np.flatnonzero((np.diff(doubt) > 1) | (np.diff(chain[doubt]) > 0)) + 1
            start = doubt[np.concatenate(([0], cut))]
            size = np.diff(np.concatenate(([0], cut, [len(doubt)])))
            order = np.argsort(-size, kind="stable")
            start, size = start[order], size[order]
            back = np.zeros((len(e), 3), np.int8)
            best = e[start] + self.trans[0]
            alive = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")  # runs longer than k
            for k in range(1, size[0]):
                n = alive[k]
                step = best[:n, :, None] + self.trans
                back[start[:n] + k] = step.argmax(axis=1)
                best[:n] = step.max(axis=1) + e[start[:n] + k]
            t = (best + self.trans[:, 0]).argmax(axis=1)  # what follows is outside
            for k in range(size[0] - 1, -1, -1):
                n = alive[k]
                at = start[:n] + k
                tags[at] = t[:n]
                t[:n] = back[at, t[:n]]
        return np.split(tags, np.cumsum(sizes)[:-1])


def fit(chains: list[tuple[list[tuple], list[int], int]], steps: int = STEPS) -> Model:
    """Weights from chains of (classes, tags, file feature), by gradient ascent on the exact likelihood, with a small penalty."""
    model = Model(sorted({c for classes, _, _ in chains for c in classes}, key=repr))
    if not any(any(t) for _, t, _ in chains):
        model.file[:, 0] = 20.0
        return model
    width = max(len(c) for c, _, _ in chains)
    n = len(chains)
    ids, tag, live = np.zeros((n, width + 4), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    files = np.array([f for _, _, f in chains])
    for i, (c, t, _) in enumerate(chains):
        ids[i, 2 : 2 + len(c)] = [model.index[x] for x in c]
        tag[i, : len(c)], live[i, : len(c)] = t, True
    moments: dict[str, list] = {}
    for step in range(1, steps + 1):
        e = np.repeat(model.file[files][:, None, :], width, axis=1)
        for p, off in enumerate(model.PLACES):
            e = e + model.emit[p][ids[:, 2 + off : 2 + off + width]]
        a, b = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        a[:, 0] = e[:, 0] + model.trans[0]
        for i in range(1, width):
            v = a[:, i - 1, :, None] + model.trans
            top = v.max(axis=1)
            a[:, i] = np.where(live[:, i, None], top + np.log(np.exp(v - top[:, None]).sum(axis=1)) + e[:, i], a[:, i - 1])
        for i in range(width - 2, -1, -1):
            v = model.trans + (e[:, i + 1] + b[:, i + 1])[:, None, :]
            top = v.max(axis=2)
            b[:, i] = np.where(live[:, i + 1, None], top + np.log(np.exp(v - top[:, :, None]).sum(axis=2)), 0.0)
        top = a[:, -1].max(axis=1)
        z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(axis=1))
        belief = np.exp(np.minimum(a + b - z[:, None, None], 0)) * live[:, :, None]
        gap = (np.eye(3)[tag] * live[:, :, None]) - belief
        grads = {"file": np.zeros_like(model.file), "emit": np.zeros_like(model.emit), "trans": np.zeros_like(model.trans)}
        np.add.at(grads["file"], files, gap.sum(axis=1))
        for p, off in enumerate(model.PLACES):
            np.add.at(grads["emit"][p], ids[:, 2 + off : 2 + off + width].ravel(), gap.reshape(-1, 3))
        pair = a[:, :-1, :, None] + model.trans + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = live[:, 1:]
        want = np.zeros((3, 3))
        np.add.at(want, (tag[:, :-1][both], tag[:, 1:][both]), 1)
        np.add.at(want, (np.zeros(n, int), tag[:, 0]), 1)
        have = (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        have[0] += belief[:, 0].sum(axis=0)
        grads["trans"] = want - have
        for name, g in grads.items():
            w = getattr(model, name)
            g = g - 0.05 * w
            m, v = moments.setdefault(name, [np.zeros_like(w), np.zeros_like(w)])
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.trans[0, 2] = -8.0
    model.emit[:, 1] = 0.0
    return model


def _chains(text: str, known: dict, around: int = 6) -> list[tuple[list[tuple], list[int], int]]:
    """Labelled stretches of a text: around each base span and each token that isn't a plain word, and the text's beginning."""
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    classes = tokens(text, known)
    spans, tags = base_spans(text), [0] * len(at)
    k = 0
    merged: list[list[int]] = []
    for s, e, kind in spans:
        if kind == "assign":
            s = next(m.start(2) for m in ASSIGN.finditer(text, s) if m.start() == s)
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in sorted(merged):
        first = True
        while k < len(at) and at[k][1] <= s:
            k += 1
        while k < len(at) and at[k][0] < e:
            tags[k], first = (1 if first else 2), False
            k += 1
    file = _file(classes)
    marks = {i for i, c in enumerate(classes) if tags[i] or c[0] in ("code", "hint")} | ({0} if classes else set())
    out, end = [], 0
    for i in sorted(marks):
        lo, hi = max(end, i - around), min(len(classes), i + around + 1)
        if hi > lo:
            out.append((classes[lo:hi], tags[lo:hi], file))
            end = hi
    return out


def train(docs: DataFrame, sample: int = SAMPLE, chains: int = CHAINS) -> Model:
    """Fit on the base patterns' matches in at most ``sample`` documents: on at most ``chains`` stretches with and as many without a secret.

    Documents and stretches are those with the smallest hash (of identity and place), wherever they lie in a text; only the chosen ones reach the driver.
    """
    import pickle

    chosen = docs.select(DID, TKEY).distinct().orderBy(F.xxhash64(DID, TKEY), DID, TKEY).limit(sample)
    schema = f"{DID} long, {TKEY} long, place long, secret boolean, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            rows: list[tuple] = []
            for did, tk, t in zip(*(b.column(c).to_pylist() for c in (DID, TKEY, "text")), strict=True):
                rows += [(did, tk, i, any(c[1]), pickle.dumps(c)) for i, c in enumerate(_chains(t, known))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    picked = stash(docs.join(F.broadcast(chosen), [DID, TKEY]).dropDuplicates([DID, TKEY]).select(DID, TKEY, "text").mapInArrow(run, schema).withColumn("h", F.xxhash64(DID, TKEY, "place")))
    order = ["h", DID, TKEY, "place"]
    rows = [r for secret in (True, False) for r in picked.filter(F.col("secret") == secret).orderBy(*order).limit(chains).select("x").collect()]
    return fit([pickle.loads(bytes(r[0])) for r in rows])  # noqa: S301  written by the tasks above


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans array<struct<kind,s,e>> (by start, then kind) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))

    def tagged(text: str, classes: list[tuple], tags: np.ndarray, base: list) -> list[tuple[int, int, str]]:
        """Runs of tagged tokens from their first to their last code-like token, apart from base spans."""
        at = [(x.start(), x.end()) for x in _TOKEN.finditer(text)]
        runs: list[list[int]] = []
        for i in np.flatnonzero(tags):
            if tags[i] == 2 and runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        out = []
        for r in runs:
            code = [i for i in r if classes[i][0] == "code" and at[i][1] - at[i][0] >= LEAST]
            if code and all(at[code[-1]][1] <= x or at[code[0]][0] >= y for x, y, _ in base):
                out.append((at[code[0]][0], at[code[-1]][1], "crf"))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value, {}
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            out: list[list] = []
            while at < len(texts):
                held, chains, size = [], [], 0
                while at < len(texts) and size < 400_000:
                    classes = tokens(texts[at], known)
                    held.append((texts[at], classes))
                    chains.append((np.array([m.index.get(c, 1) for c in classes], np.int64), _file(classes)))
                    size += len(classes) + 1
                    at += 1
                for (text, classes), tags in zip(held, m.decode(chains), strict=True):
                    spans = base_spans(text)
                    if tags.any():
                        spans = sorted(spans + tagged(text, classes, tags, spans), key=lambda s: (s[0], KINDS.index(s[2])))
                    out.append([{"kind": k, "s": s, "e": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,s:long,e:long>>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``scan`` over the whole ``documents`` table."""
    docs = identified(table(spark, sf_dir, "documents"))
    out = scan(docs, train(docs))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return out.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def brute_spans(text: str | None) -> list[tuple[int, int, str]]:
    """The base spans by plain loops over characters, for tests."""
    text, out = text or "", []
    value = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    at = 0
    while at < len(text):
        end = 0
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                p = at + len(word)
                p += text[p : p + 1] in ("'", '"') and p < len(text)
                while text[p : p + 1] == " ":
                    p += 1
                if text[p : p + 1] not in (":", "="):
                    continue
                p += 1
                while text[p : p + 1] == " ":
                    p += 1
                p += text[p : p + 1] in ("'", '"') and p < len(text)
                q = p
                while q < len(text) and text[q] in value:
                    q += 1
                if q > p:
                    end = q
                    if q - p >= 12:
                        out.append((at, q, "assign"))
                    break
        at = end or at + 1
    for kind, head, signs, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("hex", "", "0123456789abcdef", 16)):
        at = 0
        while at < len(text):
            q = at + len(head)
            if not text.startswith(head, at):
                at += 1
                continue
            while q < len(text) and text[q] in signs:
                q += 1
            if q - at >= least and q > at + len(head):
                out.append((at, q, kind))
            at = max(q, at + 1) if q > at + len(head) else at + 1
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))
