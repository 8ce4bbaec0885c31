"""Operator 12: neighbours, forms and roots against comparing all pairs; paths over stretches; the query's words against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loglattice.llm import variants


def _vocabulary(seed, size, letters="abcé", least=1, most=7):
    rng = np.random.default_rng(seed)
    out = {}
    while len(out) < size:
        w = "".join(rng.choice(list(letters), int(rng.integers(least, most))))
        out[w] = int(2 ** rng.integers(0, 9))
    return out


@pytest.mark.parametrize("stretch", [3, 40, 20_000])
def test_groups_equal_comparing_all_pairs(spark, monkeypatch, stretch):
    monkeypatch.setattr(variants, "STRETCH", stretch)
    found = _vocabulary(stretch, 260) | {"aaaa" * 60: 5, "aaaa" * 60 + "b": 50, "xyz" * 4000: 3, "xyz" * 2000 + "a" + "xyz" * 2000: 9}
    got = variants.group_variants(spark.createDataFrame(list(found.items()), "word string, n long")).collect()
    assert len(got) == len(found)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants.brute(found)


def test_numbers_are_the_nodes_of_the_trie(spark, monkeypatch):
    """Equal prefixes have equal numbers, others differ, whatever stretch they are in."""
    monkeypatch.setattr(variants, "STRETCH", 4)
    found = sorted(_vocabulary(9, 60, "ab", 1, 9))
    rows = spark.createDataFrame([(k, k, w) for k, w in enumerate(found)], "rank long, wid long, word string")
    of_prefix = {}
    for r in variants.paths(rows).collect():
        word, low = found[r.wid], 0
        for s in r.path:
            for depth in range(low + 1, s.upto + 1):
                assert of_prefix.setdefault(word[:depth], s.made) == s.made
            low = s.upto
        assert low == len(word)
    assert all(found[made].startswith(p) for p, made in of_prefix.items())


def _words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = [f"{a}{b}" for a in ("straße", "Élan", "water", "Üben", "colour") for b in ("", "s", "en", "ing", "ingen")]
    rows = [(k, " ".join(rng.choice(base, 60)) + ("." if k % 3 else " 42x")) for k in range(300)]
    rows += [(None, "water water, Water"), (5, None), (6, ""), (7, rows[7][1]), (7, rows[7][1]), (8, "wattercolour-" * 40_000)]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = variants.op12(spark, str(tmp_path)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants.brute(_words(rows))
    assert any(r.form is not None for r in got)


def test_empty_tables_and_words_as_they_are(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.words(none)).collect() == []
    docs = spark.createDataFrame([(1, "Abcde abcde ABCDE x×y")], "doc_id long, text string")
    assert [tuple(r) for r in variants.words(docs).collect()] == [("abcde", 3)]
    one = variants.group_variants(variants.words(docs)).collect()
    assert [(r.word, r.form, r.root, r.n_near) for r in one] == [("abcde", None, "abcde", 0)]


def test_chains_end_at_their_roots(spark):
    found = {"a" * (5 + k): 2**k for k in range(9)}
    got = variants.group_variants(spark.createDataFrame(list(found.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"a" * 13}
