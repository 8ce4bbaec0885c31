"""Slot regexes from captured sample values, as SQL expressions, and the compiled patterns that worker tasks run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.functions.text import SLOT, SLOT_TYPES

#: What isn't white space in Unicode's sense, as the JVM's patterns have it.
_NO_BLANKS = r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: White space as sample values have it: with the four separators of ASCII.
_BLANK = r"[\s\x1c-\x1f]"
#: Digits that aren't decimal ones (superscripts, circled digits); they count as numeric all the same.
_DIGITS = "".join(c for c in map(chr, range(0x20000)) if c.isdigit() and not c.isdecimal())


def compiled(template: str, slots: list[str] | None) -> re.Pattern:
    parts = template.split(SLOT)
    slots = [_NO_BLANKS if s is None or s == r"\S+" else s for s in [*(slots or ()), *[None] * len(parts)]]
    body = "".join(re.escape(p) + (f"({slots[i]})" if i < len(parts) - 1 else "") for i, p in enumerate(parts))
    return re.compile(body, re.S)


class UNSURE:
    """What ``scanned`` gives where only the regex can tell; a class, since a worker gets a copy of any other object."""


_BLANKS = re.compile(_NO_BLANKS.replace("[^", "[").removesuffix("+"))


def scanned(line: str, template: str) -> list[str] | object | None:
    """The values that ``compiled(template, None)`` captures from a line, found without a regex; None where it doesn't fit, UNSURE where blanks leave it open.

    From the end, each literal is taken where it occurs last before a slot of a character or more: the regex takes the last places that fit too.
    Where such a slot has a blank, an earlier place of the literal behind it may do, unless that is the line's end.
    """
    parts = template.split(SLOT)
    if len(parts) == 1:
        return [] if line == template else None
    low, end = len(parts[0]), len(line) - len(parts[-1])
    if end <= low or not line.startswith(parts[0]) or not line.endswith(parts[-1]):
        return None
    values = []
    for k in range(len(parts) - 2, -1, -1):
        at = line.rfind(parts[k], low + 1, end - 1) if k else 0
        if at < 0:
            return None
        value = line[at + len(parts[k]) : end]
        if _BLANKS.search(value):
            return None if k == len(parts) - 2 else UNSURE
        values.append(value)
        end = at
    return values[::-1]


def captured(line: Column, literals: Column) -> Column:
    """The values of the slots between ``literals`` (one more than slots) in a line, each as short as the literals allow; null where the line doesn't fit.

    One scan: the first literal begins the line and the last ends it; each one between is taken where it occurs first behind a slot of a
    character or more.  Taking it there leaves most room for the rest, so this finds what a search with backtracking would.
    """
    last = F.element_at(literals, -1)
    none = F.lit(None).cast("string")
    begin = F.struct(
        F.when(line.startswith(literals[0]), F.substring(line, F.length(literals[0]) + 1, F.length(line))).alias("rest"), F.array().cast("array<string>").alias("found")
    )

    def step(done: Column, literal: Column) -> Column:
        rest = done["rest"]
        # 1 + the slot's length; 0 if there is no place for it
        at = F.when(literal == "", F.when(F.length(rest) > 0, 2).otherwise(0)).otherwise(F.call_function("locate", literal, rest, F.lit(2)))
        return F.struct(
            F.when(at > 0, F.substring(rest, at + F.length(literal), F.length(rest))).otherwise(none).alias("rest"),
            F.when(at > 0, F.array_append(done["found"], F.substring(rest, F.lit(1), at - 1))).otherwise(done["found"]).alias("found"),
        )

    def end(done: Column) -> Column:
        rest = done["rest"]
        n = F.length(rest) - F.length(last)
        return F.when(rest.endswith(last) & (n > 0), F.array_append(done["found"], F.substring(rest, F.lit(1), n)))

    between = F.slice(literals, F.lit(2), F.greatest(F.size(literals) - 2, F.lit(0)))
    return F.when(F.size(literals) > 1, F.aggregate(between, begin, step, end)).when(line == last, F.array().cast("array<string>"))


def slot_regex(values: Column, kind: Column, trailing: Column) -> Column:
    """The regex for a slot from its sample values, its semantic type (null: none), and whether it ends the template."""
    numeric, blanks = (F.coalesce(kind.isin([k for k, x in SLOT_TYPES.items() if x[i]]), F.lit(False)) for i in (0, 1))
    bare = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, rf"(?U)^{_BLANK}+", ""), rf"(?U){_BLANK}+\z", ""))
    every = lambda p: F.forall(bare, lambda v: v.rlike(p))
    return (
        F.when(F.size(values) == 0, F.when(trailing & blanks, ".+").otherwise(r"\S+"))
        .when((blanks & trailing) | F.exists(bare, lambda v: v.rlike(f"(?U){_BLANK}")), F.when(trailing, ".+").otherwise(".+?"))
        .when(numeric & every(rf"(?U)^[\d{_DIGITS}]+\z"), r"\d+")
        .when(numeric & every(r"^[0-9a-fA-F]+\z"), "[0-9a-fA-F]+")
        .otherwise(r"\S+")
    )


def infer(proposals: DataFrame) -> DataFrame:
    """``slot_regexes`` for rows with template, samples and slot_types: one for each slot, from the samples that fit the template.

    Samples that are null or don't fit have no say.  A template without slots has no regexes; a slot without a type isn't numeric.
    """
    literals, kinds = text.literals(F.col("template")), F.col("slot_types")
    fits = F.filter(F.transform("samples", lambda line: captured(line, literals)), lambda found: found.isNotNull())
    n = F.size(literals) - 1
    slots = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n)
    one = lambda fit: F.transform(
        slots, lambda i: slot_regex(F.transform(fit, lambda found: F.get(found, i)), F.get(kinds, i), (i == n - 1) & F.col("template").endswith(SLOT))
    )
    return proposals.withColumn("slot_regexes", F.transform(F.array(fits), one)[0])  # the captures are worked out once
