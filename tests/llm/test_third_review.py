"""What the third review found: memory of op13's sample, null lists in op2, the fingerprints of the pipeline's near-dedup."""

import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from loglattice.llm import phrases, shinglesets, simhash, toxicity


@pytest.fixture
def sent(spark, monkeypatch):
    """The frames sent to Python, with the function and the schema of what comes back."""
    seen, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, kind, **k: seen.append((df, f, kind)) or plain(df, f, kind, **k))
    return seen


def test_op13_holds_few_texts_at_a_time(spark, sent):
    docs = spark.createDataFrame([(k, f"w{k} shared word w{k % 7}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    toxicity.train(toxicity.identified(docs), labels)
    run = next(f for _, f, kind in sent if "x array" in str(kind))
    rows = pa.RecordBatch.from_pydict({toxicity.TKEY: list(range(450)), "y": pa.array([0] * 450, pa.int32()), "text": [f"a b c{k}" for k in range(450)]})
    got = list(run(iter([rows])))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(450))
    assert max(b.num_rows for b in got) <= 200


def test_op2_sends_no_null_lists(spark, sent):
    some = " ".join(f"w{k}" for k in range(40))
    rows = [(1, some), (2, "own start " + some), (3, "nothing repeats here"), (4, None), (5, f"x {some} y {some}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.dedup_phrases(docs).collect()}
    assert got == {d: (n, gone) for d, n, gone, _ in phrases.brute(rows)}
    lists = [(df, f.name) for df, *_ in sent for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    assert lists and all(df.filter(df[c].isNull()).isEmpty() for df, c in lists)


def test_near_dedup_takes_fingerprints_first(spark, monkeypatch):
    asked = []
    plain = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or plain(*a, **k))
    base = [f"t{k}" for k in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[1:])), (4, " ".join(f"u{k}" for k in range(90))), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(shinglesets.brute(rows)) == [1, 4, 5]
    assert asked
