"""Texts of files whose encoding isn't stated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("replaced", T.BooleanType())])
#: Below this share of plausible characters a guess is marked for review.
SURE = 0.5


def _plausible(text: str) -> float:
    """Share of the characters beyond ASCII that Japanese text mostly has."""
    odd = [c for c in text if c > "\x7f"]
    good = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "　" <= c <= "〟" or "！" <= c <= "～" for c in odd)
    return good / len(odd) if odd else 0.0


# --- fixed values: the marks that begin UTF-32 and UTF-16, longer ones first
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def guess(data: bytes) -> tuple[str, str, float] | None:
    """(text, name, share) of the encoding that a mark names, else of the more plausible of two Japanese ones that fit."""
    best = None
    for mark, name in MARKS:
        if data.startswith(mark):
            try:
                return data.decode(name), name, 1.0
            except UnicodeDecodeError:
                break
    for name, codec in (("shift_jis", "cp932"), ("euc-jp", "euc-jp")):
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        share = _plausible(text)
        if share > 0 and (best is None or share > best[2]):
            best = (text, name, share)
    return best


def decode(data: bytes, fallback: tuple[str, ...] = ("cp932", "euc-jp", "latin-1"), fast: bool = False) -> tuple[str, str, bool]:
    """(text, encoding, to be reviewed): UTF-8, a guess, then the fallbacks, the last of which always succeeds.

    ``fast`` tries the fallbacks but the last before guessing.
    """
    strict = [n for n in fallback[:-1]]
    for name in ["utf-8", *(strict if fast else [])]:
        try:
            return data.decode(name), name, False
        except UnicodeDecodeError:
            pass
    found = guess(data)
    if found is not None:
        return found[0], found[1], found[2] < SURE
    for name in strict:
        try:
            return data.decode(name), name, False
        except UnicodeDecodeError:
            pass
    return data.decode(fallback[-1], "replace"), fallback[-1], True


def decoded(content: Column, fallback: tuple[str, ...], fast: bool = False) -> Column:
    """(text, encoding, replaced) of a binary column; UTF-8 stays in the JVM."""

    @F.pandas_udf(DECODED)
    def guessed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([decode(bytes(b), fallback, fast) if b is not None else (None, None, None) for b in batch], columns=DECODED.names)

    valid = F.call_function("is_valid_utf8", content.cast("string"))
    utf8 = F.struct(content.cast("string").alias("text"), F.lit("utf-8").alias("encoding"), F.lit(False).alias("replaced"))
    # only what isn't UTF-8 goes to Python; the rest is null there
    other = guessed(F.when(~valid, content))
    return F.when(valid, utf8).otherwise(other)
