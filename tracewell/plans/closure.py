"""Names followed to a fixed point: who introduces which name, and where it occurs next.

The result is that of processing occurrences one by one, by hop, then path, line and name: a name's
occurrence hangs on those introducers that came before it. As sets: an introducer carries the time of
the occurrence it stands for, and an edge exists where that time is less than the child's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import is_plain, occurrences
from ..sources.staging import Tables

INTRODUCED = "keyword string, symbol string, parent struct<symbol: string, relpath: string, lineno: int>, at struct<hop: int, relpath: string, lineno: int, symbol: string>, role string, kind string, ord int, seed boolean"
SCANNED = "keyword string, symbol string, hop int, chase boolean, terminal boolean"


@dataclass
class Closure:
    """``introduced``: name, parent and time; ``scanned``: name and hop; ``found``: occurrences of scans."""

    introduced: DataFrame
    scanned: DataFrame
    found: DataFrame
    beyond: DataFrame  # parents past the last hop


def _time(hop: Column, relpath: Column, lineno: Column, symbol: Column) -> Column:
    return F.struct(hop.cast("int").alias("hop"), relpath.alias("relpath"), lineno.cast("int").alias("lineno"), symbol.alias("symbol"))


def _node(symbol: Column, relpath: Column, lineno: Column) -> Column:
    return F.struct(symbol.alias("symbol"), relpath.alias("relpath"), lineno.cast("int").alias("lineno"))


def follow(seeds: DataFrame, lines: DataFrame, tokens: DataFrame, line_symbols: DataFrame, max_depth: int = 10, max_symbols: int | None = 100_000, items: int | None = None) -> Closure:
    """Follow the names bound where the ``seeds`` are.

    ``seeds``: keyword, ord (their order), relpath, lineno. ``line_symbols``: relpath, lineno, symbol,
    kind (constant, var, getter or setter), ord; only names that may be followed. Getters and setters
    are looked up but lead no further. ``max_symbols`` names a keyword are followed at most, by hop,
    length and name, all of them if it is None; with an item budget, fewer, so that twice their number
    stays within it.
    """
    spark = seeds.sparkSession
    tables = Tables(spark, "closure")
    role = F.when(F.col("kind").isin("constant", "var"), "chase").otherwise("terminal")
    bound = line_symbols.select("relpath", "lineno", "symbol", "kind", "ord", role.alias("role"))
    limit = min((n for n in (max_symbols, None if items is None else items // 2) if n is not None), default=None)

    first = seeds.select("keyword", "relpath", "lineno", "ord").join(bound.withColumnRenamed("ord", "n"), ["relpath", "lineno"])
    first = first.select("keyword", "symbol", _node(F.col("keyword"), F.col("relpath"), F.col("lineno")).alias("parent"), _time(F.lit(0), F.lpad(F.col("ord").cast("string"), 12, "0"), F.lit(0), F.lit("")).alias("at"), "role", "kind", F.col("n").alias("ord"), F.lit(True).alias("seed"))
    introduced = [tables.put(first, "introduced0")] if max_depth >= 1 else [spark.createDataFrame([], INTRODUCED)]
    beyond = [] if max_depth >= 1 else [first.select("keyword", "parent").distinct()]
    scanned, found, total, capped = spark.createDataFrame([], SCANNED), None, 0, None
    for hop in range(1, max_depth + 1):
        names = introduced[-1].groupBy("keyword", "symbol").agg(F.max(F.col("role") == "chase").alias("chase"), F.max(F.col("role") == "terminal").alias("terminal"))
        done = scanned.groupBy("keyword", "symbol").agg(F.max("chase").alias("c"), F.max("terminal").alias("t"))
        names = names.join(done, ["keyword", "symbol"], "left")
        names = names.select("keyword", "symbol", F.lit(hop).alias("hop"), (F.col("chase") & ~F.coalesce("c", F.lit(False))).alias("chase"), (F.col("terminal") & ~F.coalesce("t", F.lit(False))).alias("terminal"))
        frontier = tables.put(names.where("chase or terminal"), f"frontier{hop}")
        n, n_plain = frontier.agg(F.count("*"), F.count_if(is_plain(F.col("symbol")))).first()
        total += n
        if limit is not None and total > limit:  # earlier hops come first, so names once within the limit stay there
            capped = tables.put(_over(_union(introduced), limit), f"capped{hop}")
            frontier = tables.put(frontier.join(capped, ["keyword", "symbol"], "left_anti"), f"uncapped{hop}")
        if not n:
            break
        scanned = scanned.unionByName(frontier)
        where = occurrences(lines, tokens, frontier.select("symbol").distinct(), n == n_plain)
        here = tables.put(where.join(frontier, "symbol").select("keyword", "symbol", "relpath", "lineno", "hop", "chase", "terminal"), f"found{hop}")
        found = here if found is None else found.unionByName(here)
        grown = here.where("chase and not terminal").join(bound.withColumnRenamed("symbol", "next"), ["relpath", "lineno"]).where("next <> symbol")
        grown = grown.select("keyword", F.col("next").alias("symbol"), _node(F.col("symbol"), F.col("relpath"), F.col("lineno")).alias("parent"), _time(F.col("hop"), F.col("relpath"), F.col("lineno"), F.col("symbol")).alias("at"), "role", "kind", "ord", F.lit(False).alias("seed"))
        if hop == max_depth:
            beyond.append(here.where("chase and not terminal").select("keyword", _node(F.col("symbol"), F.col("relpath"), F.col("lineno")).alias("parent")))
            break
        introduced.append(tables.put(grown, f"introduced{hop}"))
    every = _union(introduced)
    if found is None:
        found = spark.createDataFrame([], "keyword string, symbol string, relpath string, lineno int, hop int, chase boolean, terminal boolean")
    past = beyond[0] if beyond else every.select("keyword", "parent").where("false")
    if capped is not None:
        every, found = every.join(capped, ["keyword", "symbol"], "left_anti"), found.join(capped, ["keyword", "symbol"], "left_anti")
    return Closure(every, scanned, found, past)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def first_names(introduced: DataFrame, limit: int) -> DataFrame:
    """(keyword, symbol) of the first ``limit`` names of each keyword, by hop, length and name."""
    hops = introduced.groupBy("keyword", "symbol").agg(F.min("at.hop").alias("h"))
    # the limit is pushed below the shuffle, so a task gets the first names of each other task only
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("h", F.length("symbol"), "symbol"))
    return hops.withColumn("r", rank).where(F.col("r") <= limit).select("keyword", "symbol")


def _over(introduced: DataFrame, limit: int) -> DataFrame:
    """(keyword, symbol) of the names past the limit of their keyword."""
    names = introduced.select("keyword", "symbol").distinct()
    return names.join(first_names(introduced, limit), ["keyword", "symbol"], "left_anti")


def edges(closure: Closure) -> DataFrame:
    """(keyword, parent, child), each once."""
    earliest = closure.introduced.groupBy("keyword", "symbol", "parent").agg(F.min("at").alias("at"))
    child = closure.found.select("keyword", "symbol", _node(F.col("symbol"), F.col("relpath"), F.col("lineno")).alias("child"), _time(F.col("hop"), F.col("relpath"), F.col("lineno"), F.col("symbol")).alias("then"))
    joined = earliest.join(child, ["keyword", "symbol"]).where((F.col("parent") != F.col("child")) & (F.col("at") < F.col("then")))
    return joined.select("keyword", "parent", "child").distinct()


def kinds(closure: Closure) -> DataFrame:
    """(keyword, symbol, kind) by the first introduction; names to follow come before others there."""
    order = F.struct("at", (F.col("role") != "chase").alias("later"), "ord")
    return closure.introduced.groupBy("keyword", "symbol").agg(F.min_by("kind", order).alias("kind"))
