"""Occurrences of names against a plain search of every line."""

import random
import re

from tracewell.operators import index


def test_occurrences_equal_a_plain_search(spark):
    chance = random.Random(5)
    bits = ["a", "b1", "_c", "$", "-", "@", "\\E", "\\Q", ".", " ", "é"]
    make = lambda n: "".join(chance.choice(bits) for _ in range(chance.randint(0, n)))
    lines = [("f", k + 1, make(9)) for k in range(150)]
    names = sorted({make(4) for _ in range(150)} | {"$", "@@", "a-b1"})
    table = spark.createDataFrame(lines, "relpath string, lineno int, line string")
    found = index.occurrences(table, index.token_index(table), spark.createDataFrame([(n,) for n in names], "symbol string"))
    wanted = {(n, "f", k) for _, k, line in lines for n in names if n and re.search(rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", line)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted and sum(not re.fullmatch("[A-Za-z0-9_]+", n) for n, *_ in wanted) > 100
