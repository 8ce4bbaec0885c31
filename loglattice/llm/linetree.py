"""Line dedup by a log-template tree, in DataFrame operations only.

A line falls down a tree of fixed depth: by its number of tokens, then by each of its first DEPTH tokens, where a
token with a digit counts as ``<*>``.  Only leaves that lines of at least MIN_DOCS documents reach can hold a recurring
template.  Within such a leaf, a position keeps a token that more than half of the leaf's (document, line) pairs
have there and is variable (``<*>``) otherwise, so two lines share a template only by what they have in common.  A line whose masked tokens agree with the leaf's template in at least
SIMILARITY of the positions behind the leading ones takes the leaf's template; other lines keep their own masked text
as template.  A template that lines of MIN_DOCS or more documents have is recurring: of its lines the first (smallest
doc_id, then line) stays and all others are dropped, so text that is copied as a whole survives once.

Defined results: null text has no lines and stays null; blank lines are never dropped; repeated rows are one document,
and lose the same lines; texts of one doc_id are one document for counting, with lines of their own; a null doc_id counts as the smallest; of tokens
that are equally frequent none has a majority; lines of any length are taken whole; an empty table gives an empty one; other columns may have any
names and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DID, TKEY, carried, identified, joinable, let, stash, table

DEPTH, MIN_DOCS, SIMILARITY = 3, 2, 0.6
#: Bits of the first of the two hashes that make a key (tests cut them).
FIRST_BITS = 64
SIEVE_BITS = 1 << 26
_BLANKS = r"[\x20\x09-\x0D]+"
WILD = "<*>"


def _masked(plain: Column) -> Column:
    """``plain`` with every token that has a digit as ``<*>``."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<!\S)[^\s\d]*+\d\S*", WILD)).otherwise(plain)


def _parted(line: Column) -> Column:
    """The tokens joined by one blank."""
    return F.when(line.rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"), F.trim(F.regexp_replace(line, _BLANKS, " "))).otherwise(line)


def _key(*parts: Column | str) -> Column:
    """128 bits for what lines have in common: two hashes with different seeds, the first of which also deals lines out."""
    first = F.xxhash64(*parts)
    if FIRST_BITS < 64:
        first = first.bitwiseAND(F.lit((1 << FIRST_BITS) - 1).cast("long"))
    return F.struct(first.alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))


def lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """_did, _tk, place, leaf (key of the path) and plain text of every line with a token."""
    rows = identified(docs).select(DID, TKEY, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(DID, TKEY, "place", _parted(F.col("line")).alias("plain"))
    n = F.octet_length("plain") - F.octet_length(F.replace(F.col("plain"), F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("leaf", _key(n, _masked(F.substring_index("plain", " ", depth))))


def _sieved(rows: DataFrame, keys: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` without most of those whose leaf isn't in ``keys``; an exact join must follow where that matters.

    The keys go to the workers as bits of a bitmap, in pieces of 4 KB: ``bits`` (a power of two) / 8 bytes at most, however many
    keys there are.
    """
    slot = F.col("leaf.a").bitwiseAND(F.lit(bits - 1).cast("long"))
    part, at = F.call_function("bitmap_bucket_number", slot), F.call_function("bitmap_bit_position", slot)
    dealt = keys.select(part.alias("part"), at.alias("at")).repartition("part")
    joined = rows.withColumn("part", part).join(F.broadcast(stash(dealt.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")))), "part")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    return joined.filter(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def _alike(kinds: DataFrame, depth: int, similarity: float) -> DataFrame:
    """leaf, kind, template of the masked texts (leaf, masked, n) that take their leaf's template."""
    tokens = kinds.select("leaf", "n", F.posexplode(F.split("masked", " ")).alias("p", "token"))
    common = tokens.groupBy("leaf", "p", "token").agg(F.sum("n").alias("n"))
    best = common.groupBy("leaf", "p").agg(F.sum("n").alias("all"), F.max(F.struct("n", "token")).alias("top"))
    token = F.when(2 * F.col("top.n") > F.col("all"), F.col("top.token")).otherwise(F.lit(WILD))
    made = best.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("p", token.alias("token")))).alias("path"))
    made = made.select("leaf", F.transform("path", lambda x: x["token"]).alias("tree"))

    def same(t: Column) -> Column:
        return F.aggregate(
            F.transform(t, lambda x, i: F.when((i >= depth) & (x == F.get(F.col("tree"), i)), 1).otherwise(0)), F.lit(0), lambda a, v: a + v
        )

    free = F.size("tree") - depth
    fits = (free > 0) & (let(F.split("masked", " "), same) >= similarity * free)
    return kinds.join(made, "leaf").filter(fits).select("leaf", _key("masked").alias("kind"), _key("leaf", "tree").alias("template"))


def recurring(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Lines to drop: _did, _tk, place.

    Lines are counted by keys of 128 bits.  Only leaves that hold several masked texts need a template, so only their texts are shuffled.
    """
    every = lines(docs, depth)
    marks = stash(every.select("leaf", _key(_masked(F.col("plain"))).alias("kind"), DID, TKEY, "place"))
    counted = marks.groupBy("leaf").agg(F.count_distinct(DID).alias("docs"), (F.min("kind") != F.max("kind")).alias("several"))
    leaves = stash(counted.filter(F.col("docs") >= min_docs).select("leaf", "several"))
    mixed = leaves.filter("several").select("leaf")
    inside = _sieved(every.select("leaf", "plain"), mixed).select("leaf", _masked(F.col("plain")).alias("masked"))
    kinds = inside.groupBy("leaf", "masked").agg(F.count("*").alias("n"))
    alike = stash(_alike(stash(kinds.join(joinable(mixed), "leaf", "left_semi")), depth, similarity))
    rows = _sieved(marks, leaves).join(joinable(alike), ["leaf", "kind"], "left")
    rows = stash(rows.select(F.coalesce("template", _key("leaf", "kind")).alias("template"), DID, TKEY, "place"))
    many = rows.groupBy("template").agg(F.count_distinct(DID).alias("docs"), F.min(DID).alias("least")).filter(F.col("docs") >= min_docs)
    hits = rows.join(joinable(stash(many.select("template", "least"))), "template")
    own = hits.filter(F.col(DID) == F.col("least"))  # of each template, lines of one doc_id
    nth = F.rank().over(Window.partitionBy("template").orderBy(TKEY, "place"))
    later = own.withColumn("nth", nth).filter("nth > 1").select(DID, TKEY, "place")
    return hits.filter(F.col(DID) != F.col("least")).select(DID, TKEY, "place").unionByName(later)


def drop_recurring(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Each whole row of ``docs`` as the struct ``row``, its ``text`` without the dropped lines, beside n_lines and n_dropped."""
    gone = recurring(docs, depth, min_docs, similarity).groupBy(DID, TKEY).agg(F.collect_set("place").alias("gone"))
    text = F.col("row.text").cast("string")

    def cut(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")

    left = F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), cut))
    n = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = carried(docs).join(gone.hint("shuffle_hash"), [DID, TKEY], "left")
    return out.select(
        F.col("row").withField("text", left).alias("row"), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_lines, n_dropped and the text that is left."""
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", "row.text")


def brute(rows: list[tuple[int, str | None]], depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> list[tuple]:
    """The same by plain loops, for tests (distinct doc_ids)."""
    import re
    from collections import Counter, defaultdict

    leaf_of, members = {}, defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else ()):
            w = [WILD if re.search("[0-9]", x) else x for x in re.split(_BLANKS, line) if x]
            if w:
                leaf = (len(w), *w[:depth])
                leaf_of[d, i] = (leaf, tuple(w))
                members[leaf].append((d, tuple(w)))
    tree = {}
    for leaf, m in members.items():
        if len({d for d, _ in m}) >= min_docs:
            out = []
            for p in range(leaf[0]):
                c = Counter(w[p] for _, w in m)
                n, tok = max((n, tok.encode()) for tok, n in c.items())
                out.append(tok.decode() if 2 * n > len(m) else WILD)
            tree[leaf] = tuple(out)
    places = defaultdict(list)
    for (d, i), (leaf, w) in leaf_of.items():
        if leaf in tree:
            t, free = tree[leaf], leaf[0] - depth
            alike = free > 0 and sum(a == b for a, b in zip(w[depth:], t[depth:], strict=True)) >= similarity * free
            places[leaf, 0 if alike else w].append((d, i))
    gone = set()
    for v in places.values():
        if len({d for d, _ in v}) >= min_docs:
            gone |= set(v) - {min(v)}
    result = []
    for d, t in rows:
        x = t.split("\n") if t is not None else []
        kept = [y for i, y in enumerate(x) if (d, i) not in gone]
        result.append((d, len(x), len(x) - len(kept), None if t is None else "\n".join(kept)))
    return result
