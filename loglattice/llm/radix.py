"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``size`` bytes, most significant digit (8 bytes) first, and a suffix leaves as soon
as it is alone in its bucket; buckets that survive every digit are exactly the repeated windows.

* Buckets of the first pass: the anchor that a window picks out of its own bytes (see ``repeats``).  Consecutive suffixes
  with one anchor move as one bundle (a span), so a row is shuffled for about ``(size - gram) / 2`` bytes; only bundles that aren't alone
  in their bucket bring their bytes.
* Passes over bundles: digit by digit through all their bytes.  All suffixes of equal bundles but the first's are repeats.
* Passes over single suffixes, for bundles of one bucket that differ: by their distance from the anchor, then digit by digit.

Hashes decide where bytes meet, never that they are equal.
Defined results: null or short texts have no windows and stay whole; rows that repeat both ``doc_id`` and
text are one place (neither is earlier) and get equal results; texts of one doc_id are told apart, of two windows at the same start neither
is earlier; a null ``doc_id`` counts as the smallest; an empty table gives an empty one; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import DID, TKEY, placed, pressed, stash, table, unpressed

#: Windows of this many bytes; grams of this many bytes are hashed for the anchors; bytes of a digit.
SIZE, GRAM, DIGIT = 100, 40, 8
#: Suffixes and bundles that are worked on at a time.
ROWS = 100_000
_BUNDLES = f"deal long, {DID} long, s long, {TKEY} long, n long, off long, later boolean, bytes binary"
_RANGES = f"{DID} long, {TKEY} long, s long, e long"


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of bytes as an Arrow column."""
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def bundles(texts: DataFrame, lists: DataFrame, hot: np.ndarray, size: int, gram: int, encode: Callable = repeats.bytes_to_codes) -> DataFrame:
    """The bundles of ``lists`` with their bytes, dealt by their anchor; those of hot anchors as single windows, dealt by their content.

    Of equal single windows that a worker holds at a time only the first brings its bytes; the others are ``later`` ones.
    All rows of ``texts`` go through the exchange (a left join), so that a caller who joins the same frame by the same keys again shares it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(hot)
    names = [c.split()[0] for c in _BUNDLES.split(", ")]

    def made(deal: np.ndarray, did: np.ndarray, s: np.ndarray, tk: np.ndarray, n: np.ndarray, off: np.ndarray, later: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        body = _binary(data, at, np.where(later, 0, n - 1 + size))
        return pa.RecordBatch.from_arrays([*map(pa.array, (deal.view(np.int64), did, s, tk, n, off, later)), body], names)

    def singles(data: np.ndarray, did: np.ndarray, tk: np.ndarray, s: np.ndarray, at: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((s, did, key))
        did, tk, s, at, key = (x[order] for x in (did, tk, s, at, key))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
        rows = np.flatnonzero((did != did[first]) | (s != s[first]))
        body = data.tobytes()
        later = np.zeros(len(key), bool)
        later[rows] = [body[a : a + size] == body[b : b + size] for a, b in zip(at[rows].tolist(), at[first[rows]].tolist(), strict=True)]
        spread = repeats.mix(did.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64))
        one = np.ones(len(key), np.int64)
        return made(np.where(later, spread, key), did, s, tk, one, 0 * one, later, data, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("spans").is_valid())
            if not batch.num_rows:
                continue
            row, s, n, off = repeats.listed_spans(batch.column("spans"))
            dids, tks = batch.column(DID).to_numpy(), batch.column(TKEY).to_numpy()
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            cold: list[tuple] = []
            warm: list[tuple] = []
            held = 0
            for i, text in enumerate(unpressed(batch.column("z"))):
                mine = slice(ends[i], ends[i + 1])
                a, m, o = s[mine], n[mine], off[mine]
                data = np.frombuffer(text, np.uint8)
                h = repeats.Hashes(encode(text))
                anchor = h.gram_at(a + o, gram)
                is_hot = repeats.is_in(anchor, sent.value)
                cold.append((data, anchor[~is_hot], a[~is_hot], m[~is_hot], o[~is_hot], i))
                if is_hot.any():
                    which = np.repeat(np.flatnonzero(is_hot), m[is_hot])
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(m[is_hot]) - m[is_hot], m[is_hot])
                    at = a[which] + nth
                    warm.append((data, h.slices(at, at + size), at, i))
                held += len(a) + len(data) // size + (len(at) if is_hot.any() else 0)
                if held >= ROWS or i == batch.num_rows - 1:
                    shift = np.cumsum([0] + [len(c[0]) for c in cold])
                    data = np.concatenate([c[0] for c in cold])
                    deal, a, m, o = (np.concatenate([c[j] for c in cold]) for j in (1, 2, 3, 4))
                    doc = np.repeat([c[5] for c in cold], [len(c[1]) for c in cold]).astype(np.int64)
                    base = np.repeat(shift[:-1], [len(c[1]) for c in cold])
                    if len(a):
                        yield made(deal, dids[doc], a, tks[doc], m, o, np.zeros(len(a), bool), data, base + a)
                    if warm:
                        data = np.concatenate([c[0] for c in warm])
                        shift = np.cumsum([0] + [len(c[0]) for c in warm])[:-1]
                        doc = np.repeat([c[3] for c in warm], [len(c[2]) for c in warm])
                        at = np.concatenate([c[2] for c in warm])
                        yield singles(data, dids[doc], tks[doc], at, at + np.repeat(shift, [len(c[2]) for c in warm]), np.concatenate([c[1] for c in warm]))
                    cold, warm, held = [], [], 0

    joined = texts.join(lists.hint("shuffle_hash"), [DID, TKEY], "left")
    return joined.select(*texts.columns, "spans").mapInArrow(run, _BUNDLES)


def passes(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Refine ``group`` until members are equal in their ``size`` bytes from ``at``: most-significant-digit passes.

    Members of a group have equal sizes.  Those that are alone after a pass take no part in the next; the groups returned are
    numbered anew and a member that is alone has a group of its own.
    """
    padded = np.concatenate((data, np.zeros(DIGIT, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, DIGIT)
    out = np.full(len(at), -1, np.int64)
    alive, groups, taken = np.arange(len(at)), group, 0
    depth, whole = 0, int(size.max()) if len(size) else 0
    while True:
        order = np.argsort(groups, kind="stable")
        alive, groups = alive[order], groups[order]
        new = np.concatenate(([True], groups[1:] != groups[:-1]))
        alone = new & np.append(new[1:], True)
        done = alone | (size[alive] <= depth)
        number = np.cumsum(new) - 1
        out[alive[done]] = taken + number[done]
        taken += int(number[-1]) + 1 if len(number) else 0
        alive, number = alive[~done], number[~done]
        if not len(alive) or depth >= whole:
            return out
        left = size[alive] - depth
        digit = words[at[alive] + depth].copy().view(">u8").ravel()
        short = np.minimum(left, DIGIT)
        digit = digit.astype(np.uint64) >> (np.uint64(8) * (np.uint64(DIGIT) - short.astype(np.uint64)))
        order = np.lexsort((digit, number))
        alive, number, digit = alive[order], number[order], digit[order]
        groups = np.cumsum(np.concatenate(([True], (number[1:] != number[:-1]) | (digit[1:] != digit[:-1]))))
        depth += DIGIT


def _earliest(group: np.ndarray, did: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The member of each member's group with the smallest place."""
    order = np.lexsort((s, did, group))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return first


def _ranges(did: np.ndarray, tk: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (did, tk, s, e)], [c.split()[0] for c in _RANGES.split(", ")])


def _sorted_suffixes(cols: list[np.ndarray], data: np.ndarray, start: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Ranges to remove, of complete buckets (rows sorted by bucket)."""
    deal, did, s, tk, n, off = cols
    bucket = np.cumsum(np.concatenate(([True], deal[1:] != deal[:-1])))
    order = np.lexsort((n, bucket))  # bundles of other lengths aren't equal
    group = np.empty(len(n), np.int64)
    group[order] = np.cumsum(np.concatenate(([True], (bucket[order][1:] != bucket[order][:-1]) | (n[order][1:] != n[order][:-1]))))
    group = passes(data, start, n - 1 + size, group)
    first = _earliest(group, did, s)
    later = (did != did[first]) | (s != s[first])
    if later.any():
        yield _ranges(did[later], tk[later], s[later], (s + n - 1 + size)[later])
    # one bundle of each kind, but all rows of its place; buckets with one kind only are done
    kinds = np.bincount(bucket, first == np.arange(len(first)))
    left = np.flatnonzero(~later & (kinds[bucket] > 1))
    cuts = np.searchsorted(bucket[left], np.unique(bucket[left]))  # buckets whole, about ROWS suffixes at a time
    ends = np.append(cuts[1:], len(left))
    total = np.cumsum(n[left]) if len(left) else np.zeros(0)
    begin = 0
    for end in ends:
        if end < len(left) and total[end - 1] - (total[begin - 1] if begin else 0) < ROWS:
            continue
        rows = left[begin:end]
        begin = end
        which = np.repeat(rows, n[rows])
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        key = np.lexsort((off[which] - nth, bucket[which]))
        far, home = (off[which] - nth)[key], bucket[which][key]
        group = np.empty(len(which), np.int64)
        group[key] = np.cumsum(np.concatenate(([True], (far[1:] != far[:-1]) | (home[1:] != home[:-1]))))
        group = passes(data, start[which] + nth, np.full(len(which), size), group)
        at, doc = s[which] + nth, did[which]
        first = _earliest(group, doc, at)
        gone = (doc != doc[first]) | (at != at[first])
        if gone.any():  # runs of suffixes of a bundle
            rows_, at, nth_ = which[gone], at[gone], nth[gone]
            new = np.concatenate(([True], (rows_[1:] != rows_[:-1]) | (nth_[1:] != nth_[:-1] + 1)))
            end_ = np.append(np.flatnonzero(new)[1:], len(at)) - 1
            yield _ranges(did[rows_[new]], tk[rows_[new]], at[new], at[end_] + size)


def repeated(rows: DataFrame, size: int) -> DataFrame:
    """Byte ranges [s, e) that repeat an earlier window, of ``bundles``; buckets are dealt out by one exchange and never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            if not part.num_rows:
                return
            column = part.column("bytes").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
            cols = [part.column(c).to_numpy() for c in ("deal", DID, "s", TKEY, "n", "off")]
            yield from _sorted_suffixes(cols, data[: offsets[-1]], offsets[:-1], size)

        count = 0
        for batch in batches:
            later = batch.column("later")
            known = batch.filter(later)
            if known.num_rows:
                did, tk, s = (known.column(c).to_numpy() for c in (DID, TKEY, "s"))
                yield _ranges(did, tk, s, s + size)
            batch = batch.filter(pa.compute.invert(later))
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS // 2:
                part = pa.Table.from_batches(held)
                deal = part.column("deal").to_numpy()
                cut = int(np.flatnonzero(deal != deal[-1])[-1]) + 1 if deal[0] != deal[-1] else 0
                if cut:
                    yield from work(part.slice(0, cut))
                    held = part.slice(cut).combine_chunks().to_batches()
                    count = part.num_rows - cut
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, _RANGES)


def removed_spans(docs: DataFrame, texts: DataFrame, size: int = SIZE, gram: int = GRAM, encode: Callable = repeats.bytes_to_codes) -> DataFrame:
    """Per identified document the byte ranges [s, e) that repeat an earlier window, not merged yet; ``texts``: ``docs`` pressed.

    ``encode`` gives the bytes' codes that are hashed; they needn't differ.
    """
    hot = repeats.hot_anchors(docs, encode, size, gram)
    resolved = stash(repeats.not_alone(repeats.scan_spans(docs, encode, size, gram, hot, raw=True)))
    single = repeated(bundles(texts, repeats.check_lists(resolved), hot, size, gram, encode), size)
    whole = resolved.filter(F.col("kind") == repeats.DUP)
    return whole.select(DID, TKEY, "s", (F.col("s") + F.col("n") - 1 + size).alias("e")).unionByName(single)


def merge(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of a document's removed ranges."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["s"], r["e"]) for r in ranges or ()):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def dedup_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, encode: Callable = repeats.bytes_to_codes) -> DataFrame:
    """One row per document: doc_id, removed array<struct<s,e>> (byte runs), kept binary."""
    own = placed(docs)
    texts = pressed(own)  # one frame, so that both joins by document read one exchange of the texts
    ranges = removed_spans(own, texts, size, gram, encode).groupBy(DID, TKEY).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, kept = [], []
            for text, r in zip(unpressed(b.column("z")), b.column("ranges").to_pylist(), strict=True):
                m = merge(r)
                runs.append([{"s": x, "e": y} for x, y in m])
                edges = [0, *(v for pair in m for v in pair), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "removed", "kept"],
            )

    return texts.join(ranges.hint("shuffle_hash"), [DID, TKEY], "left").select("doc_id", "z", "ranges").mapInArrow(
        cut, "doc_id long, removed array<struct<s:long,e:long>>, kept binary"
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``dedup_bytes`` over the whole ``documents`` table."""
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    gone = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"]), F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        (F.length("kept") + gone).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute(rows: list[tuple[int, str | None]], size: int = SIZE) -> list[tuple]:
    """The same by trying every window, for tests."""
    first: dict[bytes, tuple[int, int]] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < (d, i):
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out
