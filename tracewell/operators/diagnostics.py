"""Diagnostics as rows of (category, message, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Categories that are always listed in full, as are those whose name starts with ``prov_``.
EXEMPT = ("symbol_rejected", "getter_setter_no_expand")


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def detail(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """The first ``limit`` messages of each category by seq (0: all), and a line that counts the rest."""
    if limit <= 0:
        return rows.select("category", "message", F.col("seq").cast("string").alias("seq"), F.lit(False).alias("rest"))
    free = F.col("category").isin(*EXEMPT) | F.col("category").startswith("prov_")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("seq")))
    # row_number <= limit is pushed below the shuffle, so a large category costs its first rows only
    short = ranked.where(~free).where(F.col("r") <= limit).drop("r").unionByName(rows.where(free))
    over = summary(rows.where(~free)).where(F.col("n") > limit)
    more = over.select("category", F.concat(F.lit("(... "), F.col("n") - limit, F.lit(" more, "), "n", F.lit(" total)")).alias("message"), F.lit(None).cast("string").alias("seq"), F.lit(True).alias("rest"))
    return short.select("category", "message", F.col("seq").cast("string").alias("seq"), F.lit(False).alias("rest")).unionByName(more)


def render(rows: DataFrame, limit: int = 1000) -> str:
    """The counts by category, then the messages; the rows listed are bounded by ``limit`` but for exempt categories."""
    counts = sorted((r["category"], r["n"]) for r in summary(rows).collect())
    lines = ["# summary", *(f"{c}\t{n}" for c, n in counts), "# detail"]
    listed = detail(rows, limit).withColumn("place", F.col("seq").cast("long"))
    for r in listed.orderBy("category", "rest", "place").toLocalIterator():
        lines.append(f"{r['category']}\t{r['message']}")
    return "\n".join(lines) + "\n"
