"""Removal of passages of words that occur earlier, located by sharded Aho-Corasick automata.

1. Confirm: spans of windows that recur (see ``repeats``), and single windows of spans that share only an anchor.  Recurrences that go on in
   the same earlier document are one passage, known by its first place.
2. Compile: documents are dealt to shards by a hash; the words of every passage are taken from its first place and sent to
   the shards where it recurs; a shard compiles them (as sequences of word numbers) into one automaton.  Shards grow in number, not size.
3. Stream: every document of the shard runs through its automaton; each occurrence that starts later than the
   passage's first place is removed.  Nothing is removed that the automaton hasn't matched word for word.

Defined results: null text has no words; texts shorter than a window stay whole; a null ``doc_id`` counts as the
smallest; rows that repeat ``doc_id`` and text are one place and get equal results; texts of one doc_id are told apart, of two windows at the
same start neither is earlier; an empty table gives an empty one; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import DID, TKEY, placed, pressed, stash, table, unpressed

#: Windows of this many words; grams of this many words are hashed for the anchors; characters of text in a shard.
SIZE, GRAM, SHARD_CHARS = 20, 7, 8_000_000


def _encode(text: bytes) -> np.ndarray:
    return repeats.words_to_codes(text.split())


def confirmed(docs: DataFrame, texts: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Recurring passages: place (document, first word, number of words) of an occurrence and an earlier place of it."""
    hot = repeats.hot_anchors(docs, _encode, size, gram)
    resolved = stash(repeats.resolve(repeats.scan_spans(docs, _encode, size, gram, hot, content=True)))
    single = repeats.equal_windows(repeats.window_rows(texts, repeats.check_lists(resolved), _encode, size, gram))
    whole = resolved.filter(F.col("kind") == repeats.DUP)
    place = [DID, TKEY, "s", "f_did", "f_tk", "f_s"]
    return whole.select(*place, (F.col("n") - 1 + size).alias("words")).unionByName(single.select(*place, F.lit(size).cast("long").alias("words")))


def _shard(shards: int):
    return F.pmod(F.xxhash64(DID, TKEY), F.lit(shards))


def passages(claims: DataFrame, shards: int) -> DataFrame:
    """Distinct passages by their first place (f_did, f_tk, f_s, words), with the shards where they recur."""
    kind = "f_did long, f_tk long, f_s long, words long, shard long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("found")
            flat, sizes = found.flatten(), np.diff(found.offsets.to_numpy())
            s, words, f_did, f_tk, f_s = (flat.field(i).to_numpy() for i in range(5))
            row = np.repeat(np.arange(len(found)), sizes)
            order = np.lexsort((s, s - f_s, f_tk, f_did, row))
            s, words, f_did, f_tk, f_s, row = (x[order] for x in (s, words, f_did, f_tk, f_s, row))
            same = (row[1:] == row[:-1]) & (f_did[1:] == f_did[:-1]) & (f_tk[1:] == f_tk[:-1]) & ((s - f_s)[1:] == (s - f_s)[:-1])
            # ends so far within a run of one document and shift; a claim that begins behind them begins a passage
            run_id = np.cumsum(np.concatenate(([True], ~same)))
            reach = np.maximum.accumulate(s + words + run_id * (1 << 40)) - run_id * (1 << 40)
            new = np.concatenate(([True], ~same | (s[1:] > reach[:-1])))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            shard = b.column("shard").to_numpy()[row[first]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f_did[first], f_tk[first], f_s[first], reach[last] - s[first], shard)], [c.split()[0] for c in kind.split(", ")])

    grouped = claims.groupBy(DID, TKEY).agg(F.collect_list(F.struct("s", "words", "f_did", "f_tk", "f_s")).alias("found"))
    return grouped.select("found", _shard(shards).cast("long").alias("shard")).mapInArrow(run, kind).distinct()


def patterns(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The words of every passage, taken from its first place, for each shard: shard, f_did, f_s, words, z (compressed)."""
    kind = "f_did long, f_tk long, f_s long, words long, z binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, told = zstandard.ZstdCompressor(level=3).compress, set()
        for b in batches:
            b = b.filter(b.column("z").is_valid())
            rows: list[tuple] = []
            for did, tk, text, cuts in zip(b.column(DID).to_pylist(), b.column(TKEY).to_pylist(), unpressed(b.column("z")), b.column("cuts").to_pylist(), strict=True):
                if tk:  # only rows of a doc_id with several rows have one: they may be repeated
                    if (did, tk) in told:
                        continue
                    told.add((did, tk))
                words = text.split()
                rows += [(did, tk, c["f_s"], c["words"], press(b" ".join(words[c["f_s"] : c["f_s"] + c["words"]]))) for c in cuts]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.binary())], [c.split()[0] for c in kind.split(", ")])

    key = ["f_did", "f_tk", "f_s", "words"]
    cuts = found.select(*key).distinct().groupBy(F.col("f_did").alias(DID), F.col("f_tk").alias(TKEY)).agg(F.collect_list(F.struct("f_s", "words")).alias("cuts"))
    some = F.coalesce("cuts", F.array().cast("array<struct<f_s:long,words:long>>")).alias("cuts")
    looked = [F.when(F.col("cuts").isNotNull(), F.col(c)).alias(c) if c == "z" else c for c in texts.columns]
    cut = texts.join(cuts.hint("shuffle_hash"), [DID, TKEY], "left").select(*looked, some).mapInArrow(run, kind)
    return cut.join(found, key).select("shard", "f_did", "f_s", "words", "z")


def _locate(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    dids = docs.column(DID).to_pylist()
    texts = unpressed(docs.column("z"))
    numbers: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    firsts = (found.column(c).to_pylist() for c in ("f_did", "f_s"))
    for f_did, f_s, words in zip(*firsts, unpressed(found.column("z")), strict=True):
        pattern = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words.split()])
        old = machine.get(pattern, None)
        if old is None or (f_did, f_s) < old[:2]:
            machine.add_word(pattern, (f_did, f_s, len(pattern)))
    if len(machine):
        machine.make_automaton()
    total, gone_n, kept = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int32)
        if len(machine):
            d, get = dids[i], numbers.get
            for end, (f_did, f_s, n) in machine.iter(tuple([get(w, 0) for w in words])):
                start = end + 1 - n
                if f_did < d or f_did == d and f_s < start:
                    gone[start] += 1
                    gone[end + 1] -= 1
        dead = np.cumsum(gone[:-1]) > 0
        total.append(len(words))
        gone_n.append(int(dead.sum()))
        kept.append(b" ".join(words if not dead.any() else [w for w, x in zip(words, dead, strict=True) if not x]))
    return pa.Table.from_arrays(
        [docs.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "n_removed", "kept"],
    )


def dedup_phrases(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (kept words joined by a blank)."""
    own = placed(docs)
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    texts = pressed(own)  # one frame, so that both joins by document read one exchange of the texts
    found = stash(passages(confirmed(own, texts, size, gram), shards))
    return (
        texts.withColumn("shard", _shard(shards))
        .groupBy("shard")
        .cogroup(patterns(texts, found).groupBy("shard"))
        .applyInArrow(_locate, "doc_id long, n_words long, n_removed long, kept string")
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``dedup_phrases`` over the whole ``documents`` table."""
    out = dedup_phrases(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], size: int = SIZE) -> list[tuple]:
    """The same by trying every window, for tests."""
    first: dict[tuple, tuple[int, int]] = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - size + 1):
            w = tuple(t[i : i + size])
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if first[tuple(t[i : i + size])] < (d, i):
                gone[i : i + size] = [True] * size
        kept = b" ".join(w for w, x in zip(t, gone, strict=True) if not x)
        out.append((d, len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
