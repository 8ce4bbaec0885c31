"""Repeated windows of a sequence, found without shuffling every window.

A *window* is ``size`` consecutive symbols (words or bytes) of one document.  Each window picks the position
of its smallest hashed ``gram`` of symbols (leftmost on ties): the pick depends on the window's content alone,
so two equal windows pick the same relative position and the same *anchor* (the gram's hash).  Consecutive
windows with one pick form a *span*.  Only spans are shuffled, by anchor: about one row for ``(size - gram) / 2`` symbols.

A span that is alone with its anchor can't hold a repeated window.  What is not alone goes back to its document, whose text tells the
rest; hashes decide only where windows meet.

An anchor that would fill a large part of a task by itself (``hot``, from a sixteenth of the documents; this decides how work is dealt out,
not the result) doesn't meet by its anchor: its windows do, one by one, by their content.

Rows with equal (document, start) are the same place: neither is earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DID, TKEY, stash, unpressed

DUP, CHECK = 1, 2
SPAN_SCHEMA = f"kind int, deal long, span long, {DID} long, {TKEY} long, s long, n long, off long, f_did long, f_tk long, f_s long"
#: One document in SHARE is counted to find hot anchors; spans that are held to be compared before they are shuffled.
SHARE, HELD = 16, 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, as far as a document has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            up, down = np.full(size, _BASE), np.full(size, inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Hashes:
    """Hashes of any slices of one document's symbol codes."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def gram_at(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])


def picks(grams: np.ndarray, windows: int) -> np.ndarray:
    """For each run of ``windows`` grams the position of the smallest, leftmost on ties."""
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < windows:
        step = min(reach, windows - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def spans(codes: np.ndarray, size: int, gram: int):
    """Start, number of windows, pick, anchor and content hash of each span of one document; None if it is too short."""
    if len(codes) < size:
        return None
    h = Hashes(codes)
    grams = h.grams(gram)
    at = picks(grams, size - gram + 1)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(start, len(at)))
    pick = at[start]
    return start, count, pick - start, grams[pick], h.slices(start, start + count + size - 1)


def hot_anchors(docs: DataFrame, encode: Callable, size: int, gram: int) -> np.ndarray:
    """Anchors (sorted) that a quarter of a task's rows or more would have; at most four for each shuffle partition, or one in 32 counted spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(encode(t), size, gram) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            every = np.concatenate([np.zeros(0, np.uint64), *(f[3] for f in found if f is not None)])
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["anchor"])

    spark = docs.sparkSession
    part = docs.filter(F.pmod(F.xxhash64(DID, TKEY), F.lit(SHARE)) == 0).select("text").mapInArrow(run, "anchor long")
    counts = stash(part.groupBy("anchor").agg(F.count("*").alias("n")).filter("n >= 32"))
    total = counts.agg(F.sum("n")).first()[0] or 0  # of the frequent ones, so the share is larger still
    least = max(32, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = counts.filter(F.col("n") >= least).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _columns(rows: list[np.ndarray]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]
    kinds = [pa.int32()] + [pa.int64()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if i == 0 else x, k) for i, (x, k) in enumerate(zip(rows, kinds, strict=True))], names)


def scan_spans(docs: DataFrame, encode: Callable[[bytes], np.ndarray], size: int, gram: int, hot: np.ndarray, content: bool = False, raw: bool = False) -> DataFrame:
    """Spans of every document (columns of SPAN_SCHEMA): ``kind`` 0, or CHECK if the anchor is hot, or DUP.

    ``span`` is the hash of the span's content, if ``content`` asks for it; ``raw``: symbols are single bytes, and equal
    spans are compared byte by byte (else by hash, for callers that confirm).

    Pre-aggregation: of the spans that a worker holds at a time, equal ones are shuffled once, the
    earliest; the others are known to repeat it, so a passage that a third of all rows share doesn't meet in one task.
    ``deal`` is the anchor for ``kind`` 0 and a key of its own for the others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        codes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            did, tk, s, n, off, anchor, span, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s, did, span, anchor))
            did, tk, s, n, off, anchor, span, text = (x[order] for x in (did, tk, s, n, off, anchor, span, text))
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (did != did[first]) | (s != s[first])
            keep = new | later | (tk != tk[first])
            if raw:
                rows = np.flatnonzero(later)
                later[rows] = [a == b for a, b in zip(_cut(codes, text, s, n, rows, size), _cut(codes, text, s, n, first[rows], size), strict=True)]
            kind = np.where(later, DUP, np.where(is_in(anchor, sent.value), CHECK, 0))
            spread = mix(did.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64))
            deal = np.where(kind > 0, spread, anchor).view(np.int64)
            cols = [kind, deal, span.view(np.int64) if content else np.zeros(len(s), np.int64), did, tk, s, n, off] + [np.where(later, x[first], 0) for x in (did, tk, s)]
            back = np.argsort(order[keep], kind="stable")  # rows of one document side by side: they compress well
            return _columns([c[keep][back] for c in cols])

        for batch in batches:
            dids, tks = batch.column(DID).to_numpy(), batch.column(TKEY).to_numpy()
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                code = encode(text)
                found = spans(code, size, gram)
                if found is None:
                    continue
                s, n, off, anchor, span = found
                parts.append((np.full(len(s), dids[i]), np.full(len(s), tks[i]), s, n, off, anchor, span, np.full(len(s), len(codes))))
                codes.append(np.frombuffer(text, np.uint8) if raw else None)
                held += len(s)
                if held >= HELD:
                    yield flush()
                    parts, codes, held = [], [], 0
        if parts:
            yield flush()

    return docs.select(DID, TKEY, "text").mapInArrow(run, SPAN_SCHEMA)


def _cut(codes: list[np.ndarray], text: np.ndarray, s: np.ndarray, n: np.ndarray, rows: np.ndarray, size: int) -> Iterator[bytes]:
    """The symbols of some spans."""
    for i, a, b in zip(text[rows].tolist(), s[rows].tolist(), (s + n - 1 + size)[rows].tolist(), strict=True):
        yield codes[i][a:b].tobytes()


def not_alone(rows: DataFrame) -> DataFrame:
    """DUP rows, and as CHECK the others that share their anchor with another place; one shuffle and a pass with one row of state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the rows of the last place, and whether they were told
        told = was = False
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            known = cols[0] != 0
            if known.any():
                yield _columns([c[known] for c in cols])
                cols = [c[~known] for c in cols]
            if not len(cols[0]):
                continue
            before = 0
            if held is not None:
                before = len(held[0])
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            near = cols[1][1:] == cols[1][:-1]
            other = (cols[3][1:] != cols[3][:-1]) | (cols[5][1:] != cols[5][:-1])
            place = np.cumsum(np.concatenate(([0], ~near | other)))  # repeated rows are one place
            link = near & other
            check = np.bincount(place, np.concatenate(([False], link)) | np.append(link, False)) > 0
            check[0] |= before > 0 and told
            out = check[place]
            told = bool(check[-1])
            held = [c[np.searchsorted(place, place[-1]) :] for c in cols]
            if before and (check[0] and was):
                out = out.copy()
                out[:before] = False
            was = told
            if out.any():
                yield _columns([np.full(out.sum(), CHECK), *(c[out] for c in cols[1:])])

    return rows.repartition("deal").sortWithinPartitions("deal", DID, "s").mapInArrow(run, SPAN_SCHEMA)


def resolve(rows: DataFrame) -> DataFrame:
    """``not_alone`` by content hash: as DUP, with its first place, what an equal span precedes; as CHECK the first of several spans of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last span's first row; its anchor's first span or not; told as CHECK or not
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            known = cols[0] != 0
            if known.any():  # they are resolved already
                yield _columns([c[known] for c in cols])
                cols = [c[~known] for c in cols]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(([v], c)) for v, c in zip(carry[0], cols, strict=True)]
            _, deal, span, did, tk, s, n, off, _, _, _ = cols
            fresh = np.concatenate(([True], deal[1:] != deal[:-1]))
            new = fresh | np.concatenate(([True], span[1:] != span[:-1]))
            if carry is not None:
                fresh[0] = carry[1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(deal)), 0))
            starts = np.flatnonzero(new)
            other = np.append(~fresh[starts[1:]], False)  # the next span has the same anchor
            check = ~fresh[starts] | other
            told = bool(check[-1])
            if carry is not None and carry[2]:
                check[0] = False
                told = told or len(starts) == 1
            later = (did != did[first]) | (s != s[first])
            rows_ = np.concatenate((np.flatnonzero(later), starts[check]))
            if len(rows_):
                tag = np.concatenate((np.full(later.sum(), DUP), np.full(check.sum(), CHECK)))
                f = first[rows_]
                yield _columns([tag, *(c[rows_] for c in (deal, span, did, tk, s, n, off)), did[f], tk[f], s[f]])
            last = starts[-1]
            carry = ([c[last] for c in cols], bool(fresh[last]), told)

    return rows.repartition("deal").sortWithinPartitions("deal", "span", DID, "s").mapInArrow(run, SPAN_SCHEMA)


def check_lists(resolved: DataFrame) -> DataFrame:
    """Per document the spans whose windows must be compared."""
    return resolved.filter(F.col("kind") == CHECK).groupBy(DID, TKEY).agg(F.collect_list(F.struct("s", "n", "off")).alias("spans"))


def listed_spans(column: pa.Array) -> tuple[np.ndarray, ...]:
    """For a column of check_lists: row, s, n and off of every span."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    return (np.repeat(np.arange(len(column)), sizes), *(flat.field(i).to_numpy() for i in range(3)))


WORD_CODES: dict[bytes, int] = {}


def words_to_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit code for each word; codes of frequent words are remembered (the memory is emptied when it is full)."""
    import xxhash

    known = WORD_CODES
    if len(known) > 500_000:
        known.clear()
    digest = xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = digest(w)
        out.append(c)
    return np.array(out, np.uint64)


_BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def bytes_to_codes(text: bytes) -> np.ndarray:
    return _BYTE_CODES[np.frombuffer(text, np.uint8)]




CLAIM_SCHEMA = f"{DID} long, {TKEY} long, s long, f_did long, f_tk long, f_s long"


def window_rows(texts: DataFrame, lists: DataFrame, encode: Callable[[bytes], np.ndarray], size: int, gram: int) -> DataFrame:
    """The single windows of the listed spans of ``pressed`` texts, by content hash.

    Of equal windows that a worker holds at a time only the first is to meet others; the others come with its place (f_did and so on).
    All rows and columns of ``texts`` go through the exchange (a left join), so that a caller who joins the same frame
    by the same keys again shares it; texts without such spans are left out behind it, still compressed.
    """
    names = ["deal", DID, TKEY, "s", "later", "f_did", "f_tk", "f_s"]

    def made(out: list) -> pa.RecordBatch:
        key, did, tk, s = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((s, did, key))
        key, did, tk, s = (x[order] for x in (key, did, tk, s))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
        later = (did != did[first]) | (s != s[first])
        spread = mix(did.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64))
        cols = [np.where(later, spread, key).view(np.int64), did, tk, s, later, *(np.where(later, x[first], 0) for x in (did, tk, s))]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            batch = batch.filter(batch.column("z").is_valid())
            if not batch.num_rows:
                continue
            row, s, n, _ = listed_spans(batch.column("spans"))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            dids, tks = batch.column(DID).to_numpy(), batch.column(TKEY).to_numpy()
            for i, text in enumerate(unpressed(batch.column("z"))):
                h = Hashes(encode(text))
                a, m = s[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]
                at = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
                one = np.ones(len(at), np.int64)
                out.append([h.slices(at, at + size), one * dids[i], one * tks[i], at])
                held += len(at)
                if held >= HELD:
                    yield made(out)
                    out, held = [], 0
        if out:
            yield made(out)

    joined = texts.join(lists.hint("shuffle_hash"), [DID, TKEY], "left")
    # a batch's null lists cost the square of their number on the way to Python, and texts that aren't looked at needn't go there
    some = F.coalesce("spans", F.array().cast("array<struct<s:long,n:long,off:long>>")).alias("spans")
    looked = [F.when(F.col("spans").isNotNull(), F.col(c)).alias(c) if c == "z" else c for c in texts.columns]
    return joined.select(*looked, some).mapInArrow(run, f"deal long, {DID} long, {TKEY} long, s long, later boolean, f_did long, f_tk long, f_s long")


def equal_windows(rows: DataFrame) -> DataFrame:
    """Claims: windows that also start earlier, with their first place.  Dealt by content, sorted; state: one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CLAIM_SCHEMA.split(", ")]
        carry = None
        for batch in batches:
            later = batch.column("later").to_numpy(zero_copy_only=False)
            if later.any():
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(batch.column("later")) for c in names], names)
            cols = [batch.column(c).to_numpy()[~later] for c in ("deal", DID, TKEY, "s")]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(([v], c)) for v, c in zip(carry, cols, strict=True)]
            key, did, tk, s = cols
            first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
            late = (did != did[first]) | (s != s[first])
            if late.any():
                f = first[late]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[late], tk[late], s[late], did[f], tk[f], s[f])], names)
            carry = [c[first[-1]] for c in cols]

    return rows.repartition("deal").sortWithinPartitions("deal", DID, "s").mapInArrow(run, CLAIM_SCHEMA)
