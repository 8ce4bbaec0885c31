"""Slot regexes in plain Python, by a regex that backtracks."""

import re

import regex

from loglattice.functions.text import SLOT, SLOT_TYPES


def slot_regex(values: list[str], kind: str | None, trailing: bool) -> str:
    """The regex for a slot from its sample values, its semantic type, and whether it ends the template."""
    numeric, blanks = SLOT_TYPES.get(kind or "", (False, False))
    values = [v.strip() for v in values]
    if not values:
        return ".+" if trailing and blanks else r"\S+"
    if blanks and trailing or any(re.search(r"\s", v) for v in values):
        return ".+" if trailing else ".+?"
    if numeric and all(v.isdigit() for v in values):
        return r"\d+"
    if numeric and all(re.fullmatch("[0-9a-fA-F]+", v) for v in values):
        return "[0-9a-fA-F]+"
    return r"\S+"


def captures(template: str, lines: list[str]) -> list[tuple[str, ...]]:
    """For each slot the values that it takes in the lines that fit, each slot as short as the literals allow."""
    loose = regex.compile("(.+?)".join(map(regex.escape, template.split(SLOT))), regex.S)
    rows = []
    for line in lines:
        found = loose.fullmatch(line)
        if found:
            rows.append(found.groups())
    return list(zip(*rows, strict=True)) or [()] * loose.groups


def inferred(template: str, lines: list[str], kinds: list[str]) -> list[str]:
    """Regexes of a template's slots from sample lines."""
    columns = captures(template, lines)
    last = len(columns) - 1 if template.endswith(SLOT) else -1
    named = [*kinds, *[None] * len(columns)]
    return [slot_regex(list(values), named[i], i == last) for i, values in enumerate(columns)]
