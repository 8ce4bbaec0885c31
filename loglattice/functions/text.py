"""String expressions: tokens, template correction, patterns.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "<*>"
#: The ten slot tags, with (numeric forms allowed, may span blanks).
SLOT_TYPES = {
    "OID": (False, False), "LOI": (False, False), "OBN": (False, False), "TID": (False, False), "SID": (True, False),
    "TDA": (True, True), "CRS": (True, False), "OBA": (True, False), "STC": (True, False), "OTP": (False, True),
}
_TAGS = "|".join(SLOT_TYPES)
_PATH = r"\s,!;:=|\"'\[\](){}"  # delimiters of paths, inside a character class
_MORE = _PATH + r".\-+@#$%&"  # and of numbers and words


def _re(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, to)


def tokens(c: Column) -> Column:
    """Runs without white space (of any script), '=', ':' and ','."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s=:,]+"), F.lit(0))


def strip(c: Column) -> Column:
    return _re(_re(c, r"^\s+", ""), r"\s+$", "")


def normalise(c: Column) -> Column:
    return strip(_re(c, r"\s+", " "))


def slot_types(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(f"<({_TAGS})>"), F.lit(1))


def placeholders(raw: Column) -> Column:
    """Typed and stray placeholders become slots."""
    out = _re(raw, f"<({_TAGS})>", SLOT)
    out = _re(out, r"\{[^}]+\}", SLOT)
    out = _re(out, r"<(?!\*>)[^>]+>", SLOT)
    return _re(out, r"<(?!\*>)[^>]*>", SLOT)


def _pieces(c: Column, delimiters: str, change) -> Column:
    parts = F.regexp_extract_all(c, F.lit(f"(?U)[{delimiters}]|[^{delimiters}]+"), F.lit(0))
    return F.array_join(F.transform(parts, change), "")


def _is_path(t: Column) -> Column:
    """One or more non-empty segments, each behind a slash; no regex, whose stack would grow with the segments."""
    return t.startswith("/") & ~t.endswith("/") & ~t.contains("//")


def correct(c: Column) -> Column:
    """The correction rules for a template, in their fixed order."""
    c = normalise(c)
    c = _pieces(c, _PATH, lambda t: F.when(_is_path(t), SLOT).otherwise(t))
    c = _pieces(
        c, _MORE, lambda t: F.when(t.rlike(r"(?U)^\d+$") | (t.contains(SLOT) & ~t.rlike(r"(?U)[\s/]")), SLOT).otherwise(t)
    )
    c = F.regexp_replace(c, r"<\*>(?:\.<\*>)++", SLOT)
    c = F.regexp_replace(c, r"(?:<\*>){2,}+", SLOT)
    c = F.regexp_replace(c, r"(?<= )#<\*>#?(?= )", SLOT)
    for joint in (":", "#", "/", "@", r"\."):
        c = F.regexp_replace(c, rf"<\*>(?:{joint}<\*>)++", SLOT)
    c = F.regexp_replace(c, r'(?<= )"<\*>"(?= )', SLOT)
    c = F.regexp_replace(c, r"(?<= )'<\*>'(?= )", SLOT)
    c = F.regexp_replace(c, r"(?:<\*>){2,}+", SLOT)
    return F.regexp_replace(c, r"<\*>(?: <\*>){4,}+", SLOT)


def finish(raw: Column, correction: bool = True) -> Column:
    """A raw proposal as a template."""
    out = placeholders(raw)
    return strip(correct(out) if correction else out)


def literals(template: Column) -> Column:
    return F.split(template, r"<\*>", -1)


def literal_len(template: Column) -> Column:
    return F.aggregate(literals(template), F.lit(0), lambda a, p: a + F.length(p))


def n_slots(template: Column) -> Column:
    return F.size(literals(template)) - 1


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)([^\p{Alnum}\s])", r"\\$1")


def pattern(template: Column, slots: Column | None = None) -> Column:
    """Anchored pattern with a group for each slot; ``slots``: a regex for each (default: no blanks)."""
    parts = F.transform(literals(template), escaped)
    if slots is None:
        return F.concat(F.lit("(?sU)^"), F.array_join(parts, r"(\S+)"), F.lit(r"\z"))
    groups = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("("), F.coalesce(F.get(slots, i), F.lit(r"\S+")), F.lit(")"))).otherwise(p))
    return F.concat(F.lit("(?sU)^"), F.array_join(groups, ""), F.lit(r"\z"))


def listed(c: Column) -> Column:
    """A list column as CSV text; null and empty lists become null."""
    return F.when(F.size(c) > 0, F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))


def truncated(c: Column, words: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, words), " ") if words else c


def chunk_size(rows: Column) -> Column:
    """Rows per chunk: log-linear between 3,000 (20,000 rows) and 40,000 (16 million), to 500, halves to even."""
    n = F.greatest(F.least(rows.cast("double"), F.lit(16e6)), F.lit(20e3))
    share = (F.log10(n) - F.log10(F.lit(20e3))) / (F.log10(F.lit(16e6)) - F.log10(F.lit(20e3)))
    return (F.bround((3000 + share * 37000) / 500, 0) * 500).cast("long")
