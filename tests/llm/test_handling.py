"""Clashing names, repeated rows, one id with two texts, null ids; labels by bitmap; the CRF against all paths; planted secrets."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from test_ops import corpus

from loglattice.llm import decontaminate, linetree, nbsvm, packing, phrases, quality_rules, radix, secrets, shinglesets, simhash
from loglattice.llm.common import identified

NAMES = ["_did", "_tk", "_gone", "_n", "_d", "_t", "row", "n_words", "llr", "kept", "n_lines", "gone", "seeds", "part", "bits", "id", "z", "spans", "fp", "node", "deal", "h", "t", "label"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, *[f"{n}!" for n in NAMES]) for d, t in rows], SCHEMA).repartition(3)


def odd_rows():
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(d, t) for d, t in corpus()[:12]]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (4, "another text " + long), (None, long), (None, long), (None, None), (20, ""), (21, "  \n ")]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, odd_rows()[0][1]), (2, "no such words")], "item_id long, text string")


KEEPING = {
    "op1": lambda s, d: decontaminate.drop_contaminated(d, items(s)),
    "op4": lambda s, d: simhash.keep_one(d),
    "shingles": lambda s, d: shinglesets.keep_one(d),
    "op7": lambda s, d: linetree.drop_recurring(d).select("row.*"),
    "op8": lambda s, d: quality_rules.judge(d, labels(s)).select("row.*"),
}


@pytest.mark.parametrize("name", KEEPING)
def test_users_columns_stay(spark, name):
    docs = clashing(spark, odd_rows())
    got = KEEPING[name](spark, docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert out and all(r[n] == f"{n}!" for r in out for n in NAMES)
    if name in ("op7", "op8"):
        assert len(out) == len(odd_rows())
    if name in ("op4", "shingles"):
        assert len({(r["doc_id"], r["text"]) for r in out}) == len(out)


SCORING = {
    "op1": lambda s, d: decontaminate.digest(decontaminate.contamination(d, items(s))),
    "op2": lambda s, d: phrases.dedup_phrases(d),
    "op4": lambda s, d: simhash.near_duplicates(d).select("doc_id", "fp", "component_id"),
    "op5": lambda s, d: secrets.scan(identified(d), secrets.train(identified(d))),
    "op6": lambda s, d: radix.dedup_bytes(d),
    "op9": lambda s, d: nbsvm.score(identified(d), nbsvm.train(identified(d), labels(s))),
}


@pytest.mark.parametrize("name", SCORING)
def test_repeated_rows_get_equal_results(spark, name):
    rows = odd_rows()
    got = SCORING[name](spark, clashing(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    results = [str(r) for r in got if r["doc_id"] == 3]
    assert len(results) == 3 and len(set(results)) == 1


def test_packing_takes_every_row(spark):
    rows = odd_rows()
    got = packing.pack(clashing(spark, rows)).collect()
    starts = sorted(str(r["doc_id"]) for r in got if r["start"] == 0)
    assert starts == sorted(str(d) for d, _ in rows)


def test_sum_of_squares_choice():
    """Every placement has the smallest sum of squared level counts that any level (or a new window) would give."""
    r, w = random.Random(1), 24
    packer, counts = packing.Packer(w), {}
    for i in range(400):
        size = r.randint(1, w)
        before = dict(counts)
        options = {}
        for level in [0, *[k for k, n in before.items() if n and k + size <= w]]:
            after = dict(before)
            if level:
                after[level] -= 1
            if level + size < w:
                after[level + size] = after.get(level + size, 0) + 1
            options[level] = sum(n * n for n in after.values())
        packer.place((i, 0), size)
        counts = {k: int(n) for k, n in enumerate(packer.count) if n and k < w}
        assert sum(n * n for n in counts.values()) == min(options.values())


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["sun", "moon", "tree", "river", "stone", "cloud", "bird", "road"]) + "".join(r.choice("aeiou") for _ in range(4)) for _ in range(n))
    good = [text(r.randint(40, 120)) for _ in range(60)]
    item = text(30)
    rows = list(enumerate(good)) + [(100, "y " + good[0]), (101, good[1] + " x"), (102, f"{text(20)} {item}"), (103, "short"), (104, None), (105, "again and " * 60)]
    docs = clashing(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(60), 102]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        out = now.collect()
        assert all(x[n] == f"{n}!" for x in out for n in NAMES)
        seen[name] = {x["doc_id"] for x in out}
    assert not seen["quality_rules"] & {103, 104, 105} and seen["quality_rules"] >= set(range(60)) | {100, 101, 102}
    assert seen["near_dedup"] == seen["line_dedup"] - {100, 101}
    assert seen["decontamination"] == set(range(60)), seen
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == seen["decontamination"]


def test_many_labels_shuffle_no_text(spark):
    docs = spark.range(300_000).selectExpr("id as doc_id", "concat('word', id % 50, ' of text') as text")
    many = spark.range(300_000).selectExpr("id as doc_id", "1 as quality")
    plan = quality_rules._trusted(docs, many)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" not in plan and "Broadcast" in plan
    odd = spark.createDataFrame([(d, "a") for d in (-5, -1, 0, 1, 2, 32768, 32769, 10**15, None)], "doc_id long, text string")
    few = spark.createDataFrame([(-5, 1), (0, 1), (2, 0), (32768, 1), (10**15, 1), (10**15, 1), (None, 1)], "doc_id long, quality int")
    for limit in (quality_rules.BITMAP_BYTES, 0):
        assert {r["doc_id"]: r["t"] for r in quality_rules._trusted(odd, few, limit).collect()} == {-5: 1, -1: 0, 0: 1, 1: 0, 2: 0, 32768: 1, 32769: 0, 10**15: 1, None: 0}


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(7)
    for _ in range(30):
        model = secrets.Model([("a",), ("b",), ("c",)])
        model.emit[:] = r.normal(0, 2, model.emit.shape)
        model.file[:] = r.normal(0, 1, model.file.shape)
        model.trans[:] = r.normal(0, 2, (3, 3))
        model.trans[0, 2] = -8.0
        chains = [(r.integers(0, 5, n), int(r.integers(0, 4))) for n in (1, 2, 5, 6)]
        for (ids, file), tags in zip(chains, model.decode(chains), strict=True):
            padded = np.concatenate(([0, 0], ids, [0, 0]))

            def score(path, ids=ids, file=file, padded=padded, model=model):
                total = model.trans[0, path[0]] + model.trans[path[-1], 0]
                for i, y in enumerate(path):
                    total += model.file[file, y] + sum(model.emit[p][padded[i + 2 + off], y] for p, off in enumerate(model.PLACES))
                    total += model.trans[path[i - 1], y] if i else 0
                return total

            best = max(itertools.product(range(3), repeat=len(ids)), key=score)
            assert abs(score(best) - score(tuple(tags))) < 1e-9


def planted(seed=9, n=400):
    """Texts, the places of planted secrets behind words that the base patterns know, and of others that only their context tells."""
    r = random.Random(seed)
    code = lambda k: "".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKMNPQRSTUVWXYZ23456789") for _ in range(k - 2)) + "7x"
    plain = lambda k: " ".join(r.choice(["the", "server", "was", "started", "in", "March", "2024", "by", "ticket", "A12", "and", "it", "runs"]) for _ in range(k))
    rows, hidden = [], {}
    for i in range(n):
        text = plain(r.randint(5, 40)) + "\n"
        if i % 2:
            text += f"{r.choice(['password', 'token', 'secret', 'api_key'])} = \"{code(r.randint(14, 28))}\"\n" + plain(8)
        elif i % 4 == 0:
            text += f"{r.choice(['auth_key', 'credential', 'pwd', 'bearer'])} = \""
            value = code(r.randint(14, 28))
            hidden[i] = (len(text), len(text) + len(value))
            text += value + '"\n' + plain(8)
        rows.append((i, text))
    return rows, hidden


def test_planted_secrets(spark):
    rows, hidden = planted()
    docs = identified(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.train(docs)).collect()}
    added = {(d, s["s"], s["e"]) for d, spans in found.items() for s in spans if s["kind"] == "crf"}
    want = {(d, *p) for d, p in hidden.items()}
    print("precision", len(added & want) / max(len(added), 1), "recall", len(added & want) / len(want))
    assert len(added & want) >= 0.8 * len(want) and len(added & want) >= 0.8 * len(added)


def test_secret_query_equals_plain_loops(spark, tmp_path):
    import hashlib

    r = random.Random(2)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "secret", "'", '"', ":", "=", " ", "==", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "x/y+z-w_q.r=s", "é", "\n", "Token=Secret: abcdefghijklmnop"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(500)] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for g in secrets.op5(spark, str(tmp_path)).collect():
        want = secrets.brute_spans(dict(rows)[g["doc_id"]])
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (dict(rows)[g["doc_id"]], want, g["spans"])
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == x for *_, k in want) for x in ("assign", "access", "hex"))
        assert [x for x in g["spans"].split(",") if x and not x.startswith("crf")] == [x for x in text.split(",") if x]
