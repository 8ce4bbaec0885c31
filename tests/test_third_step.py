"""The third partition step in order and support pruning, against plain loops."""

import random

from loglattice.operators import partition
from loglattice.sources.io import Saved

TABLE = "chunk_id long, token_len int, s2_pos int, s2_value string, v1 string, v2 string, n long, first long"


def visited(pairs, bound):
    """Sides of (v1, v2, n) in their order, by visiting one after another."""
    left, right, out = {}, {}, {}
    for a, b, _ in pairs:
        left.setdefault(a, set()).add(b)
        right.setdefault(b, set()).add(a)
    for a, b, n in pairs:
        c1, c2, few = len(left[a]), len(right[b]), 1 / n < bound
        out[a, b] = None
        if c1 == 1 or c2 == 1:
            out[a, b] = "v1" if c1 == c2 else ("v2" if few else "v1") if c1 > 1 else ("v1" if few else "v2")
            left[a].discard(b)
            right[b].discard(a)
    return out


def sides(spark, groups, bound=0.25):
    rows = [(g, 4, None if g % 2 else 1, None if g % 2 else "x", a, b, n, i) for g, pairs in enumerate(groups) for i, (a, b, n) in enumerate(pairs)]
    saved = Saved(spark)
    found = partition.relations_in_order(spark.createDataFrame(rows, TABLE).repartition(5), bound, saved)
    out = [{} for _ in groups]
    for r in found.collect():
        out[r["chunk_id"]][r["v1"], r["v2"]] = r["s3_side"]
    saved.clear()
    return out, saved.count


def test_in_order_equals_visiting(spark):
    r = random.Random(7)
    groups = []
    for size, names in ((3, 2), (6, 3), (12, 6), (30, 12), (40, 40), (60, 25), (80, 80), (200, 150)) * 8:
        seen = list(dict.fromkeys((f"a{r.randrange(names)}", f"b{r.randrange(names)}") for _ in range(size)))
        groups.append([(*p, r.randint(1, 8)) for p in seen])
    got, _ = sides(spark, groups)
    for mine, pairs in zip(got, groups, strict=True):
        assert mine == visited(pairs, 0.25)
    assert any(None in g.values() for g in got) and any("v2" in g.values() for g in got)


def test_long_chains_take_few_rounds(spark):
    """A path of tokens that peels from its start, and one whose start is a stuck square, so nothing of it is removed."""
    path = [(f"a{i // 2}", f"b{(i + 1) // 2}", 1 + i % 5) for i in range(3000)]
    square = [("a0", "z", 1), ("y", "z", 1), ("y", "b0", 1)]
    tail = [(f"a{(i + 1) // 2}", f"b{i // 2}", 1) for i in range(3000)]
    got, tables = sides(spark, [path, [*square, *tail, ("y", "q", 1), ("q", "z", 1)]])
    assert got == [visited(path, 0.25), visited([*square, *tail, ("y", "q", 1), ("q", "z", 1)], 0.25)]
    assert tables <= 2 + 2 * 14


def test_no_pairs(spark):
    assert partition.relations_in_order(spark.createDataFrame([], TABLE), 0.25, Saved(spark)).count() == 0


def test_events_of_outliers(spark):
    rows = [f"big u{i} v{i % 7} w{i % 3}" for i in range(90)] + [f"rare a{i} b{i} c{i}" for i in range(5)] + ["only three words", "two words"]
    vec = partition.vectors(partition.tokenise(spark.createDataFrame(list(enumerate(rows)), "row_nr long, Content string")))
    found = partition.in_order(partition.leaf_summary(partition.leaves(vec, file_support=0.02, partition_support=0.08)))
    each = {r["leaf_ord"]: r for r in partition.leaf_events(found).collect()}
    late = [r for _, r in sorted(each.items()) if r["outlier"]]
    assert [r["event"] for r in late] == [f"outlier_e{i + 1}" for i in range(len(late))]
    assert [r["outlier"] for r in late] == sorted(r["outlier"] for r in late) and [r["n"] for r in late[:3]] == [1, 1, 5]
    plain = [r["event"] for _, r in sorted(each.items()) if not r["outlier"]]
    assert plain == [f"e{i + 1}" for i in range(len(plain))]
    assert {r["event"] for r in partition.leaf_events(found, True).collect() if r["outlier"]} == {"outlier_e"}


def test_pruning_needs_no_window_over_a_chunk(spark, capsys):
    vec = partition.vectors(partition.tokenise(spark.createDataFrame([(0, "a b c")], "row_nr long, Content string")))
    partition.leaves(vec, file_support=0.1, partition_support=0.1).explain()
    assert "Window" not in capsys.readouterr().out.replace("Window [count", "")
