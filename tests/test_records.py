"""The reader of CSV records in blocks, against the reader that takes each file in one task."""

import csv
import io as text_io
import random

import pytest

from loglattice.sources import records

SCHEMA = "a long, b string, c string"


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def _one_task(spark, path, schema=SCHEMA):
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, lineSep="\n").schema(schema).csv(path)


@pytest.fixture
def blocks(spark):
    """Blocks of few bytes, so that most records pass the end of one."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def small(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield small
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def _made(seed, rows):
    """A file's text: quoted values with commas, quotes and line breaks; unquoted ones with quotes inside."""
    rnd, out = random.Random(seed), ['a,b,"c\nc"']
    for i in range(rows):
        quoted = '"' + "".join(rnd.choices(['x', ',', '\n', '""', ' ', 'é', '\n\n', '",""'[1:]], k=rnd.randint(0, 6))) + '"'
        bare = rnd.choice(["x", 'y"z', 'y" ', "", "é w", 'q""'])
        out.append(f"{i},{quoted},{bare}" if rnd.random() < 0.7 else f"{i},{bare},{quoted}")
    return "\n".join(out) + rnd.choice(["", "\n"])


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_equals_one_task(spark, tmp_path, blocks, size):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(_made(i * 10 + size, 60))
    want = _rows(_one_task(spark, str(tmp_path)))
    blocks(size)
    df = records.read_csv(spark, str(tmp_path), SCHEMA)
    assert _rows(df) == want and len(want) == 180
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3


def test_without_broadcast(spark, tmp_path, blocks, monkeypatch):
    (tmp_path / "x.csv").write_text(_made(5, 80))
    want = _rows(_one_task(spark, str(tmp_path)))
    blocks(30)
    monkeypatch.setattr(records, "_BROADCAST", 2)
    assert _rows(records.read_csv(spark, str(tmp_path), SCHEMA)) == want


def test_writer_of_another_library(spark, tmp_path, blocks):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choices('ab",\n é', k=9)), "".join(rnd.choices('",\n', k=3))) for i in range(200)]
    to = text_io.StringIO()
    csv.writer(to, lineterminator="\r\n", quoting=csv.QUOTE_ALL).writerows([("a", "b", "c"), *rows])
    (tmp_path / "x.csv").write_bytes(to.getvalue().encode())
    blocks(64)
    df = records.read_csv(spark, str(tmp_path), SCHEMA, place="nr")
    assert [tuple(r)[:3] for r in df.orderBy("nr").collect()] == rows


def test_bad_records_and_clashing_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text('_a,_record\n1,"x\ny"\nzz,k\n\n3\n4,v,more\n5,"open\nend')
    got = {r["_a"]: (r["_record"], r["broken"]) for r in records.read_csv(spark, str(tmp_path), "_a long, _record string", bad="broken").collect()}
    assert got[1] == ("x\ny", None) and got[None] == ("k", "zz,k")
    assert got[3][1] == "3" and got[4] == ("v", "4,v,more") and len(got) == 5
    assert {r["_record"] for r in records.read_csv(spark, str(tmp_path)).collect()} >= {"x\ny", "k"}


def test_headers_alone_and_empty_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\na,b,c\n")
    (tmp_path / "y.csv").write_text("")
    assert records.read_csv(spark, str(tmp_path), SCHEMA).collect() == []


def test_lines_without_quotes(spark, tmp_path, blocks):
    """Batches without a quote, between ones with quotes, in two files."""
    odd = (9_000, 9_001, 25_000)
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text("a,b,c\n" + "".join(f'{i * 10**6 + k},x,"y\nz"\n' if k in odd else f"{i * 10**6 + k},x,y\r\n" for k in range(30_000)), newline="")
    for size in (10**8, 10_000):
        blocks(size)
        got = [tuple(r) for r in records.read_csv(spark, str(tmp_path), SCHEMA, place="nr").orderBy("nr").select("a", "b", "c").collect()]
        assert sorted(got) == [(i * 10**6 + k, "x", "y\nz" if k in odd else "y") for i in range(2) for k in range(30_000)]
        assert sum(a[0] + 1 != b[0] for a, b in zip(got, got[1:], strict=False)) == 1  # in order but for the step to the other file


def test_lines_end_as_told():
    cases = [("a,b", 0, 0), ('a,"b', 0, 1), ('a,"b"', 0, 0), ('a"b', 0, 0), ('x""', 1, 1), ('x"', 1, 0), ('x","y', 1, 1), ('""",', 1, 0), ('"', 0, 1), ('""', 0, 0), ('"a"b",c', 0, 0), ("", 1, 1)]
    assert [records.ends_inside(line, bool(s)) for line, s, _ in cases] == [bool(e) for _, _, e in cases]
