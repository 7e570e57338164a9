"""Lines of files, the tokens on them, and where names occur.

A name matches where no letter, digit or underscore (ASCII) stands right before or after it. For a
name of those characters only, that means it equals a maximal run of them, so a join with the runs of
each line finds all names at once, however many they are. The runs within any other name are runs of
each line where it occurs, so it is looked for on the lines that have the one of them that stands on the
fewest lines. Names without such a run are joined on their first character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = r"^[A-Za-z0-9_]+$"


def lines(files: DataFrame, *columns: str) -> DataFrame:
    """(relpath, *columns, lineno, line) of files with a text; carriage returns stay."""
    return files.select("relpath", *columns, F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("relpath", *columns, (F.col("p") + 1).alias("lineno"), "line")


def tokens_of(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def token_index(lines_: DataFrame) -> DataFrame:
    """(relpath, lineno, token), each token of a line once."""
    return lines_.select("relpath", "lineno", F.explode(tokens_of(F.col("line"))).alias("token"))


def first_odd(symbol: Column) -> Column:
    """The first character of a name that is no ASCII letter, digit or underscore."""
    return F.regexp_extract(symbol, "(?s)([^A-Za-z0-9_])", 1)


def is_plain(symbol: Column) -> Column:
    return symbol.rlike(PLAIN)


def occurrences(lines_: DataFrame, tokens: DataFrame, symbols: DataFrame, all_plain: bool = False) -> DataFrame:
    """(symbol, relpath, lineno) where the distinct ``symbols`` (column symbol) occur.

    ``all_plain``: it is known that each is a run of letters, digits and underscores.
    """
    plain = tokens.join(symbols.where(is_plain(F.col("symbol"))), F.col("token") == F.col("symbol")).select("symbol", "relpath", "lineno")
    if all_plain:
        return plain
    odd = symbols.where(~is_plain(F.col("symbol")) & (F.col("symbol") != "")).select("symbol", tokens_of(F.col("symbol")).alias("parts"))
    bounded = F.contains("line", "symbol") & F.expr(r"line rlike concat('(?s)(?<![A-Za-z0-9_])\\Q', replace(symbol, '\\E', '\\E\\\\E\\Q'), '\\E(?![A-Za-z0-9_])')")
    parts = odd.select("symbol", F.explode("parts").alias("token"))
    often = tokens.join(parts.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = parts.join(often, "token").groupBy("symbol").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    near = tokens.join(rarest, "token").select("symbol", "relpath", "lineno").join(lines_.select("relpath", "lineno", "line"), ["relpath", "lineno"])
    # names of other characters only
    bare = odd.where(F.size("parts") == 0).select("symbol", first_odd(F.col("symbol")).alias("odd"))
    marked = lines_.where(F.col("line").rlike("[^A-Za-z0-9_]")).select("relpath", "lineno", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("(?s)[^A-Za-z0-9_]"), F.lit(0)))).alias("odd"))
    found = near.select("symbol", "relpath", "lineno", "line").unionByName(marked.join(bare, "odd").select("symbol", "relpath", "lineno", "line"))
    return plain.unionByName(found.where(bounded).select("symbol", "relpath", "lineno"))
