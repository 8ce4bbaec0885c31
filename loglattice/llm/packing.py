"""Sum-of-squares packing of tokenised documents into windows of a fixed number of tokens.

A worker packs the documents of its partition as they come.  A document longer than a window is cut: full
windows, and a rest.  A rest (or short document) goes to the fill level that makes the sum of squared counts of
partially filled windows smallest; the counts are kept in an array by level.  At a partition's end the windows that
are still partly filled are closed: the emptiest are cut up to fill the fullest, so at most one window of the
partition is padded.  Windows are numbered from ``partition * 2**33``.

The vocabulary is byte-level BPE; its path is a parameter.  Texts are encoded with the same vocabulary's ranks
(equal ids, four times as fast); texts with the vocabulary's special string, and any that the fast encoder
refuses, go through the reference tokenizer.  Null text: empty, so the end id alone.  Repeated rows are packed
like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, END_ID = 2048, 1
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"


class Encoder:
    """Ids of texts by a public vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except Exception:  # the pattern engine gives up on some very long runs
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Online sum-of-squares packing with an array of counts by fill level; ``open`` holds the windows of each level."""

    def __init__(self, window: int) -> None:
        self.window, self.next = window, 0
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of ``size`` into a window; the pieces of that window if this filled it."""
        w, count = self.window, self.count
        levels = np.flatnonzero(count[1 : w + 1 - size]) + 1  # partially filled windows with room
        # change of the sum of squares: one less at its level, one more at the level it reaches (none when full)
        reach = levels + size
        change = 2 * np.where(reach == w, 0, count[reach]) + (reach < w) - 2 * count[levels] + 1
        fresh = 0 if size == w else 2 * count[size] + 1
        level = 0
        if len(levels) and change.min() <= fresh:
            best = np.flatnonzero(change == change.min())
            level = int(levels[best[-1]])  # ties: the fullest
        if level:
            number, pieces = self.open[level].pop()
            count[level] -= 1
        else:
            number, pieces = self.next, []
            self.next += 1
        pieces.append((*piece, size, number, level))
        if level + size == w:
            return pieces
        count[level + size] += 1
        self.open[level + size].append((number, pieces))
        return None

    def close(self) -> Iterator[tuple]:
        """All pieces left: the emptiest windows' pieces are cut to fill the fullest."""
        rest = [(level, number, pieces) for level in range(self.window - 1, 0, -1) for number, pieces in self.open[level]]
        low = len(rest) - 1
        for i, (level, number, pieces) in enumerate(rest):
            if i > low:
                break
            yield from pieces
            while level < self.window and low > i:
                have, source, giving = rest[low]
                doc, start, size, _, _ = giving.pop()
                take = min(size, self.window - level)
                yield doc, start + size - take, take, number, level
                level += take
                if take < size:
                    giving.append((doc, start, size - take, source, have - size))
                have -= take
                if have:
                    rest[low] = (have, source, giving)
                else:
                    low -= 1


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(vocabulary, ranks), Packer(window)
        base = TaskContext.get().partitionId() << 33
        kept: dict[int, list] = {}  # ids of documents with pieces in open windows: doc_id, ids, pieces still open
        out: list[tuple] = []

        def tell(pieces) -> None:
            for key, start, size, number, level in pieces:
                doc_id, ids, left = kept[key]
                out.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), base + number, level))
                if left <= size:
                    del kept[key]
                else:
                    kept[key][2] = left - size

        def batch() -> pa.RecordBatch:
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            rows = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names)

        key = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                kept[key] = [doc_id, ids, len(ids)]
                for start in range(0, len(ids), window):
                    full = packer.place((key, start), min(window, len(ids) - start))
                    if full:
                        tell(full)
                key += 1
            yield batch()
        tell(packer.close())
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` over the whole ``documents`` table."""
    return pack(table(spark, sf_dir, "documents"))
