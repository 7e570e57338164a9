"""Snippets: which lines go with a hit, and their one-cell form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sanitize

# --- fixed values: limits and marks of a snippet
MAX_LINES, MAX_CHARS, SEPARATOR, CUT, ABOVE, BELOW = 12, 800, " \\n ", "…", "…(+{}上行省略)", "…(+{}下行省略)"


def physical_lines(text: Column) -> Column:
    """The lines of a text, without the empty one after a last line end."""
    parts = F.split(text, "\n", -1)
    return F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _escaped(line: str) -> str:
    return line.replace(SEPARATOR, " \\\\n ")


def clamp(lines: list[str], hit: int, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, before: int = 0, after: int = 0) -> str:
    """Lines around ``hit`` in one cell, as many as fit, taken in turn from above and below.

    ``before`` and ``after`` lines of the span are not among ``lines``: they are too far from the hit.
    """

    def cell(first: int, last: int) -> str:
        body = SEPARATOR.join([_escaped(own if k == hit else lines[k]) for k in range(first, last + 1)])
        above, below = before + first, after + len(lines) - 1 - last
        return (ABOVE.format(above) if above else "") + body + (BELOW.format(below) if below else "")

    own = lines[hit]
    if len(_escaped(own)) > max_chars:
        keep = next(n for n in range(min(len(own), max_chars), -1, -1) if len(_escaped(own[:n])) <= max_chars - len(CUT))
        own = own[:keep] + CUT
    first = last = hit
    grown = True
    while grown and last - first + 1 < max_lines:
        grown = False
        for up in (True, False):
            a, b = (first - 1, last) if up else (first, last + 1)
            if a >= 0 and b < len(lines) and b - a < max_lines and len(cell(a, b)) <= max_chars:
                first, last, grown = a, b, True
    return cell(first, last)


@F.pandas_udf(T.StringType())
def clamped(lines: pd.Series, hit: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([clamp(list(x), int(h), before=int(a), after=int(b)) if x is not None and 0 <= h < len(x) else "" for x, h, a, b in zip(lines, hit, before, after)])


def near_lines(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """(relpath, hit, language, first, last, near) of ``hits`` (relpath, lineno); line numbers from 1.

    ``lines``: relpath, language, lineno, line, stop (null where the language has no stops). A hit meets
    only the lines that its snippet may have, so the work grows with the hits and not with their files.
    """
    reach = MAX_LINES - 1
    asked = hits.where(F.col("lineno").between(1, (1 << 31) - 1)).select("relpath", F.col("lineno").alias("hit")).distinct()
    asked = asked.select("relpath", "hit", F.explode(F.sequence(F.greatest(F.lit(1), F.col("hit") - reach), F.col("hit") + reach)).alias("lineno"))
    met = asked.join(lines, ["relpath", "lineno"]).groupBy("relpath", "hit").agg(F.array_sort(F.collect_list(F.struct("lineno", "line", "stop"))).alias("near"), F.max("language").alias("language"))
    hit, numbers = F.col("hit"), lambda keep: F.transform(F.filter("near", keep), lambda x: x["lineno"])
    above, last = numbers(lambda x: x["lineno"] < hit), F.array_max(F.transform("near", lambda x: x["lineno"]))
    first = F.coalesce(F.array_max(numbers(lambda x: (x["lineno"] < hit) & x["stop"])), F.array_min(above), hit)
    met = met.where(F.exists("near", lambda x: x["lineno"] == hit)).withColumn("first", first).withColumn("most", F.least(last, F.greatest(hit + 1, F.col("first") + reach)))
    end = F.when(hit >= last, hit).otherwise(F.coalesce(F.array_min(numbers(lambda x: (x["lineno"] > hit) & (x["lineno"] <= F.col("most")) & x["stop"])), F.col("most")))
    whole = F.exists("near", lambda x: x["stop"].isNotNull())
    return met.select("relpath", "hit", "language", F.when(whole, F.col("first")).otherwise(hit).alias("first"), F.when(whole, end).otherwise(hit).alias("last"), "near")


def snippets_of(hits: DataFrame, lines: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(relpath, lineno, snippet) of the places of ``hits``; none for places past a file's end.

    ``spans``: relpath, lineno, from, to, where a line's statement is known.
    """
    near = near_lines(hits, lines)
    if spans is not None:
        near = near.join(spans.withColumnRenamed("lineno", "hit"), ["relpath", "hit"], "left")
        near = near.withColumns({"first": F.least("hit", F.coalesce("from", "first")), "last": F.greatest("hit", F.coalesce("to", "last"))})
    has = F.transform("near", lambda x: x["lineno"])
    first, last = F.greatest("first", F.array_min(has)), F.least("last", F.array_max(has))
    body = F.transform(F.filter("near", lambda x: (x["lineno"] >= F.col("a")) & (x["lineno"] <= F.col("b"))), lambda x: sanitize(x["line"]))
    near = near.withColumn("a", first).withColumn("b", last)
    return near.select("relpath", F.col("hit").alias("lineno"), clamped(body, (F.col("hit") - F.col("a")).cast("int"), (F.col("a") - F.col("first")).cast("int"), (F.col("last") - F.col("b")).cast("int")).alias("snippet"))
