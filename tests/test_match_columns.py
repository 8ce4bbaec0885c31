"""What matching sends to Python, and the scan that takes a regex's place."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loglattice.operators import catalogue as cat
from loglattice.operators import slots


def test_scan_takes_what_the_regex_takes():
    r = random.Random(1)
    sure = 0
    for _ in range(4000):
        t = "".join(r.choice(["a", "b", " ", "<*>", "<*>", "ab"]) for _ in range(r.randint(1, 7)))
        parts = (p if p != "<*>" else "".join(r.choice("aabb") if r.random() < 0.9 else " " for _ in range(r.randint(0, 4))) for p in re.split(r"(<\*>)", t))
        line = "".join(parts) if r.random() < 0.7 else "".join(r.choice("aab b") for _ in range(r.randint(0, 9)))
        m = slots.compiled(t, None).fullmatch(line)
        got = slots.scanned(line, t)
        if got is not slots.UNSURE:
            sure += 1
            assert got == (None if m is None else list(m.groups())), (t, line)
    assert sure > 3000


def test_no_null_lists_are_sent_to_python(spark, monkeypatch):
    sent = []
    frame = type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, **k: sent.append(df) or plain(df, *a, **k))
    lines = spark.range(40).select(F.col("id").alias("row_nr"), F.concat(F.element_at(F.array(*map(F.lit, ("one ", "two ", "six "))), (F.col("id") % 3 + 1).cast("int")), "id", F.lit(" end")).alias("Content"))
    entries = cat.entries(spark.createDataFrame([("one <*> end", 0), ("two <*> <*>", 1), ("<*> 7 <*>", 2)], "template string, insert_seq long"))
    few = cat.match(lines, entries, keep_entry=True).collect()
    by_key = cat.match_by_key(lines, entries, keep_entry=True).collect()
    monkeypatch.setattr(cat, "SLICE", 2)
    texts = lines.withColumnRenamed("row_nr", "LineId")
    sliced = cat.match(texts, entries, keep_entry=True).collect()
    assert sorted(map(tuple, few), key=str) == sorted(map(tuple, by_key), key=str) == sorted(map(tuple, sliced), key=str)
    none = [r for r in few if r["EventTemplate"] is None]
    assert none and all(r["ParameterList"] is None and r["SlotTypes"] is None for r in none)
    assert len(sent) >= 4
    for df in sent:
        for field in df.schema.fields:
            if isinstance(field.dataType, ArrayType):
                assert df.filter(F.col(field.name).isNull()).isEmpty(), field.name
