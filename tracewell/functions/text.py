"""Cells, paths and hops as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What would break a row or a cell of the output: control characters and line or page separators.
CONTROL = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"


def sanitize(cell: Column) -> Column:
    return F.regexp_replace(cell, CONTROL, " ")


def neutralize(cell: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def hop(symbol: Column, relpath: Column, lineno: Column) -> Column:
    return F.concat(symbol, F.lit("@"), relpath, F.lit(":"), lineno.cast("string"))


def chain(path: Column) -> Column:
    """The hops of an array of (symbol, relpath, lineno)."""
    return F.array_join(F.transform(path, lambda o: hop(o["symbol"], o["relpath"], o["lineno"])), " -> ")


def usage_summary(category: Column, language: Column) -> Column:
    return F.concat(category, F.lit(" ("), language, F.lit(")"))


def contained(relpath: Column) -> Column:
    """Whether a path is relative and stays below where it starts."""
    return F.coalesce((F.length(relpath) > 0) & ~relpath.startswith("/") & ~relpath.contains("\x00") & ~F.array_contains(F.split(relpath, "/"), ".."), F.lit(False))


def _segment(glob: str) -> str:
    """A regular expression for one path segment of a glob."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + (2 if glob[i : i + 1] == "!" else 1))) > 0:
            body, i = glob[i:end], end + 1
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]"
        else:
            out += re.escape(c)
    return out


def glob_regex(glob: str) -> str:
    """``**`` spans any number of segments; a pattern without a slash also matches a file's name."""
    parts = glob.split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    if out.endswith("/.*"):  # what ends in ** also matches the folder itself
        out = out[:-3] + "(?:/.*)?"
    return f"^(?:{out})$" if "/" in glob else f"(?:^|.*/)(?:{out})$"


def matches_any(relpath: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for glob in globs:
        found = found | relpath.rlike("(?s)" + glob_regex(glob))
    return found
