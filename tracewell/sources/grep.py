"""Search hits, a line each: ``path:lineno:content``, a file of them for each keyword."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import decode
from .walk import shown

#: The leftmost number between colons parts the path from the content.
HIT = r"(?s)^(.*?):([0-9]+):(.*)$"


def parse(rows: DataFrame, hit: str) -> DataFrame:
    """``rows`` with path, lineno and content of the column ``hit``; null where it isn't a hit."""
    line = F.regexp_replace(F.col(hit), r"[\r\n]+\z", "")
    good = line.rlike(HIT)
    part = lambda k: F.when(good, F.regexp_extract(line, HIT, k))
    return rows.withColumns({"path": part(1), "lineno": part(2).try_cast("long"), "content": part(3)})


FOUND = "keyword string, ord long, raw string, relpath string, path binary, lineno long, content string"
_BYTES = re.compile(rb"(?s)^(.*?):([0-9]+):(.*)$")
_MOST = (1 << 63) - 1


def read(spark: SparkSession, folder: str | Path, keywords: list[str], fallback: tuple[str, ...], fast: bool = False) -> DataFrame:
    """The lines of ``<keyword>.grep`` files, by ``ord``; path and number are null where a line isn't a hit.

    A file has one encoding; paths stay the bytes that they are.
    """
    folder = Path(folder).resolve()
    names = spark.createDataFrame([(k,) for k in keywords], "keyword string").repartition(max(1, len(keywords)))

    def load(batches):
        for batch in batches:
            for keyword in batch["keyword"]:
                data = (folder / f"{keyword}.grep").read_bytes()
                codec = decode(data, fallback, fast)[1]
                lines = data.split(b"\n")
                if not lines[-1]:
                    lines.pop()
                for first in range(0, len(lines), 20_000):
                    rows = []
                    for k, line in enumerate(lines[first : first + 20_000], first):
                        found = _BYTES.match(line.rstrip(b"\r\n"))
                        if found:
                            rows.append((keyword, k, None, shown(found[1]), found[1], min(int(found[2]), _MOST), found[3].decode(codec, "replace")))
                        else:
                            rows.append((keyword, k, shown(line), None, None, None, None))
                    out = pd.DataFrame(rows, columns=["keyword", "ord", "raw", "relpath", "path", "lineno", "content"])
                    yield out.assign(lineno=pd.array([r[5] for r in rows], "Int64"))

    return names.mapInPandas(load, FOUND)
