"""Operator 11: grammars and runs against plain loops, and the query against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglattice.llm import periodic
from loglattice.llm.recompress import Grammar


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=90), st.data())
def test_extensions_equal_plain_comparison(sequence, data):
    grammar = Grammar(np.array(sequence))
    for _ in range(10):
        i = data.draw(st.integers(0, len(sequence) - 2))
        j = data.draw(st.integers(i + 1, len(sequence) - 1))
        e = 0
        while j + e < len(sequence) and sequence[i + e] == sequence[j + e]:
            e += 1
        assert grammar.extension(i, j) == e


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6))
def test_runs_equal_plain_loops(texts):
    assert periodic.runs([np.array(t, int) for t in texts]) == [periodic.brute(t) for t in texts]


def test_runs_of_long_periods_and_very_long_texts():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 5000, 40_000)
    period = rng.integers(0, 5000, 9001)
    text = np.concatenate((noise, np.tile(period, 5), np.zeros(70_000, int), noise[::-1]))
    text[40_000 - 1], text[40_000 + 5 * 9001] = -1, 7000
    found = periodic.runs([text, np.array([], int), np.array([1, 1, 1, 1, 1, 1])])
    assert (40_000, 5 * 9001, 9001) in found[0] and any(r[1:] == (69_999, 1) for r in found[0])
    assert found[1:] == [[], [(0, 6, 1)]]


def _expected(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = periodic.brute(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = [(None, "a a a a a a a"), (1, None), (2, ""), (3, "   \n\t "), (5, "x y x y x y x y x y x y"), (5, "other text"), (7, "b a b a b a b a b a"), (7, "b a b a b a b a b a")]
    out += [(9, "z " * 9000 + "end " + "p q r " * 2000)]
    for k in range(100, 400):
        words = [f"w{x}" for x in rng.integers(0, 4 if k % 3 else 40, int(rng.integers(0, 90)))]
        out.append((k, " ".join(words)))
    return out


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, rows, tmp_path):
    made = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, runs int, n_words string")
    made.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11(spark, str(tmp_path)).select(*COLUMNS).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((_expected(d, t) for d, t in rows), key=key)
    assert any(r.n_runs > 1 for r in got)


def test_own_interface_returns_texts_and_runs(spark):
    docs = spark.createDataFrame([(1, "intro a b a b a b a b outro", "k"), (2, None, None)], "doc_id long, text string, period string")
    got = {r.doc_id: r for r in periodic.collapse(docs).collect()}
    assert got[1].collapsed == "intro a b outro" and [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].text.startswith("intro a b a b")
    assert got[2].collapsed == "" and got[2].n_words == 0 and got[2].runs == []
    assert periodic.collapse(docs.limit(0)).collect() == []
    assert periodic.collapse(docs, least=20).filter("size(runs) > 0").isEmpty()
