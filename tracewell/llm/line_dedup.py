"""Removal of repeated multi-line chunks whose bounds follow from the lines themselves.

DataFrame functions only. A line's hash is the first 32 bits of its MD5; a rolling hash over the
hashes of a line and the two before it ends a chunk wherever it is divisible by ``DIVISOR``, so that
lines put in or left out move no bounds but those beside them. A run of equal lines is a chunk's end
wherever it may be, before its first line too. Bounds are then thinned so that a chunk has two lines
at least, and set so that it has ``MOST_LINES`` at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Stage

DIVISOR, FACTOR, MIN_LINES, MOST_LINES = 5, 31, 2, 32
#: A chunk of a thousandth of all chunks is looked up without a shuffle; there are a thousand at most.
HOT_SHARE = 1000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def chunks(text: Column) -> Column:
    """Array of (idx, n lines, worded: lines with a word, body) of a text; null for null."""

    def bounds(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
        at = lambda h, i: F.coalesce(F.get(h, i), F.lit(0))
        rolled = lambda h, i: (at(h, i - 2) * FACTOR + at(h, i - 1)) * FACTOR + at(h, i)
        alike = lambda h, i: F.coalesce(F.get(h, i) == F.get(h, i + 1), F.lit(False))
        ends = lambda h, i: F.when((rolled(h, i) % DIVISOR == 0) | alike(h, i) | alike(h, i + 1) | alike(h, i - 1), "1").otherwise("0")
        # one mark a line: too long chunks are cut, and of marks side by side each second one goes
        marks = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ends(h, i)), "")
        thin = lambda m: F.regexp_replace(F.regexp_replace(F.regexp_replace(m, f"0{{{MOST_LINES}}}", "0" * (MOST_LINES - 1) + "1"), "^1", "0"), "11", "10")
        return _let(F.split(thin(_let(hashes, marks)), ""), lambda m: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == F.size(lines) - 1) | (F.get(m, i) == "1")))

    def cut(lines: Column, ends: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            part = F.slice(lines, begin + 1, end - begin + 1)
            worded = F.size(F.filter(part, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
            return F.struct(k.alias("idx"), (end - begin + 1).alias("n"), worded.alias("worded"), F.array_join(part, "\n").alias("body"))

        return F.transform(ends, one)

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), lambda lines: _let(bounds(lines), lambda ends: cut(lines, ends))))


def _keys(df: DataFrame, text: str, doc_id: str) -> list[Column]:
    i, t = F.col(doc_id).cast("string"), F.col(text).cast("string")
    return [F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit("row"), t, i).alias("k2")]


def remove_repeated_chunks(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with repeated chunks cut out of its text, then ``n_lines`` and ``n_lines_removed``.

    A chunk of two lines or more, two of them with a word, that stands in the table more than once
    with the same bytes stays where it first occurs, by doc_id (null last) and place in the text, and
    is removed with its line breaks everywhere else. Chunks are judged on the table as it stands.
    Rows alike in id and text are one text and keep the same. A chunk whose 128-bit hash is also that
    of other bytes is never removed. Null texts stay null with 0 lines; empty texts have one line.
    Columns named ``n_lines`` or ``n_lines_removed`` are replaced.
    """
    stage = Stage(df.sparkSession, "chunks")
    base = df.select(*_keys(df, text, doc_id), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    pieces = base.select("k1", "k2", "id", F.explode(chunks(F.col("t"))).alias("c")).where(f"c.worded >= {MIN_LINES}")
    found = stage.put(pieces.select("k1", "k2", "id", F.col("c.idx").alias("idx"), F.unhex(F.md5(F.col("c.body").cast("binary"))).alias("d")), "found")
    # a minimum and a maximum tell whether a hash has two places, and combine before the shuffle
    where = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), "k1", "k2", "idx")
    repeated = found.groupBy("d").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.count("*").alias("n")).where("first <> last").select("d", "first", "n")
    repeated = stage.put(repeated, "repeated")
    # HOT_SHARE rows at most, whatever the table holds
    hot = F.broadcast(repeated.where(F.col("n") * HOT_SHARE >= found.count()).select("d", F.col("first").alias("hot")))
    told = stage.put(found.join(hot, "d", "left"), "told")
    again = lambda first: (where != F.col(first)).alias("again")
    cold = told.where("hot is null").join(repeated, "d").select("k1", "k2", "idx", "d", again("first"))
    places = stage.put(told.where("hot is not null").select("k1", "k2", "idx", "d", again("hot")).unionAll(cold).distinct(), "places")

    # the bytes of all places of a hash: alike if the smallest are the largest
    wanted = places.groupBy("k1", "k2").agg(F.collect_set("idx").alias("idxs"))
    bodies = base.join(wanted.hint("merge"), ["k1", "k2"]).select(F.explode(F.filter(chunks(F.col("t")), lambda c: F.array_contains("idxs", c["idx"]))).alias("c"))
    bodies = bodies.select(F.unhex(F.md5(F.col("c.body").cast("binary"))).alias("d"), F.col("c.body").alias("body"))
    alike = stage.put(bodies.groupBy("d").agg(F.min("body").alias("x"), F.max("body").alias("y")).where("x = y").select("d"), "alike")
    gone = places.where("again").join(alike, "d").groupBy("k1", "k2").agg(F.collect_set("idx").alias("gone"))
    gone = stage.put(gone, "gone")
    stage.drop("found", "told", "repeated", "places", "alike")

    names = [c for c in df.columns if c not in ("n_lines", "n_lines_removed")]
    keyed = df.select(*_keys(df, text, doc_id), F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row"), F.col(text).cast("string").alias("t"))
    joined = keyed.join(gone.hint("merge"), ["k1", "k2"], "left")
    lines = F.coalesce(F.size(F.split("t", "\n", -1)), F.lit(0)).cast("long")
    lines = F.when(F.col("t").isNull(), F.lit(0).cast("long")).otherwise(lines)

    def rest(c: Column) -> Column:
        stay = F.filter(c, lambda x: ~F.array_contains("gone", x["idx"]))
        return _let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda x: x["body"]), "\n").alias("t"), F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n")))

    kept = F.when(F.col("gone").isNotNull(), _let(chunks(F.col("t")), rest))
    out = joined.select("row", "t", lines.alias("n_lines"), kept.alias("kept"))
    values = [F.coalesce("kept.t", "t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*values, "n_lines", F.coalesce(F.col("n_lines") - F.col("kept.n"), F.lit(0)).cast("long").alias("n_lines_removed"))
