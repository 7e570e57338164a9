"""Rows of a keyword as tab-separated files, split into parts, with a manifest that a later run can check.

Rows are sorted and numbered over all executors; each part is written by the task that has it, into a
folder that the driver and the executors share, under a passing name that is then changed at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import neutralize, sanitize
from ..options import Options
from ..sources.staging import Tables

# --- fixed values: the columns of a row, in order
COLUMNS = ("keyword", "language", "file", "lineno", "ref_kind", "category", "category_sub", "usage_summary", "via_symbol", "chain", "snippet", "encoding", "confidence")
# --- fixed values: what rows are sorted by, after direct ones first and indirect ones by their chain
ORDER = ("file", "lineno", "ref_kind", "via_symbol", "category", "category_sub", "confidence", "usage_summary", "snippet", "language", "encoding")

FORMAT = 1
WRITTEN = "keyword string, part long, name string, n long, sha256 string"


def order_of() -> list[Column]:
    direct = F.col("ref_kind") == "direct"
    return [F.when(direct, 0).otherwise(1), F.when(direct, "").otherwise(F.col("chain")), *map(F.col, ORDER)]


def row_line(columns: tuple[str, ...] = COLUMNS) -> Column:
    """A row as one line."""
    return F.concat_ws("\t", *[neutralize(sanitize(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns])


def numbered(rows: DataFrame, tables: Tables) -> DataFrame:
    """(keyword, line, n): the place of each row among its keyword's, from 0."""
    # a keyword is a file of the input folder
    return placed(rows, "keyword", order_of(), {"line": row_line()}, tables)


def placed(rows: DataFrame, key: str, order: list[Column], kept: dict[str, Column], tables: Tables) -> DataFrame:
    """(key, the kept columns, n): the place of each row among those of its ``key``, from 0. Keys are few.

    A sort by ranges gives each row its task and its place there; the numbers of rows of the tasks,
    one row for each, say where a task's rows begin.
    """
    rows = rows.orderBy(key, *order).select(key, *[c.alias(name) for name, c in kept.items()], F.monotonically_increasing_id().alias("at"))
    rows = tables.put(rows, "sorted")
    task = F.shiftright("at", 33)
    begin, starts = 0, []
    for row in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
        starts.append((row["task"], begin))
        begin += row["n"]
    starts = rows.sparkSession.createDataFrame(starts, "task long, begin long")
    every = rows.withColumn("task", task).join(F.broadcast(starts), "task").select(key, *kept, (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))
    # a row for each key
    firsts = every.groupBy(key).agg(F.min("n").alias("first"))
    return every.join(F.broadcast(firsts), key).select(key, *kept, (F.col("n") - F.col("first")).alias("n"))


def part_of(n: Column, most: int) -> Column:
    return F.floor(n / F.lit(most)).cast("long")


def part_name(keyword: str, part: int, parts: int) -> str:
    return f"{keyword}.tsv" if parts == 1 else f"{keyword}.part{part + 1:0{max(2, len(str(parts)))}d}.tsv"


def _replace(path: Path, pieces: Iterator[bytes]) -> str:
    """Write a file whole or not at all; the hash of its bytes."""
    passing, found = path.with_name(f".{path.name}.{uuid.uuid4().hex}"), hashlib.sha256()
    try:
        with open(passing, "wb") as f:
            for piece in pieces:
                f.write(piece)
                found.update(piece)
            f.flush()
            os.fsync(f.fileno())
        os.replace(passing, path)
    except BaseException:
        passing.unlink(missing_ok=True)
        raise
    return found.hexdigest()


def _encoded(lines: list[str], encoding: str) -> Iterator[bytes]:
    for k in range(0, len(lines), 10_000):
        # a mark of the byte order stands before the first line only
        name = encoding if not k or encoding != "utf-8-sig" else "utf-8"
        yield "".join(f"{line}\n" for line in lines[k : k + 10_000]).encode(name, "replace")


def write(rows: DataFrame, output: str | Path, keywords: dict[str, str], options: Options) -> list[dict]:
    """Write the rows (``COLUMNS``) of all ``keywords`` (name: fingerprint of its input); the manifests.

    A keyword without rows has a file with the header. Parts that an earlier manifest names and this
    one doesn't are removed once this one is there.
    """
    output, spark = Path(output).resolve(), rows.sparkSession
    output.mkdir(parents=True, exist_ok=True)
    tables = Tables(spark, "rows")
    lines = tables.put(numbered(rows, tables), "placed")
    totals = {r["keyword"]: r["n"] for r in lines.groupBy("keyword").agg(F.count("*").alias("n")).collect()}
    most, encoding, header = options.max_rows_per_part, options.output_encoding, "\t".join(COLUMNS)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keyword, number = key
        name = part_name(keyword, number, -(-totals[keyword] // most))
        text = [header, *part.sort_values("n")["line"]]
        return pd.DataFrame([(keyword, number, name, len(part), _replace(output / name, _encoded(text, encoding)))], columns=["keyword", "part", "name", "n", "sha256"])

    done = lines.withColumn("part", part_of(F.col("n"), most)).groupBy("keyword", "part").applyInPandas(one, WRITTEN).collect()  # a row a file
    out = []
    for keyword in sorted(keywords):
        parts = [{"name": r["name"], "rows": r["n"], "sha256": r["sha256"]} for r in sorted(done, key=lambda r: r["part"]) if r["keyword"] == keyword]
        if not parts:
            name = part_name(keyword, 0, 1)
            parts = [{"name": name, "rows": 0, "sha256": _replace(output / name, _encoded([header], encoding))}]
        manifest = {"format": FORMAT, "keyword": keyword, "encoding": encoding, "rows": totals.get(keyword, 0), "max_rows_per_part": most, "fingerprint": keywords[keyword], "parts": parts}
        old = {p["name"] for p in read_manifest(output, keyword).get("parts", [])}
        _replace(manifest_path(output, keyword), iter([json.dumps(manifest, ensure_ascii=True, sort_keys=True).encode()]))
        for name in old - {p["name"] for p in parts}:
            (output / name).unlink(missing_ok=True)
        out.append(manifest)
    tables.drop()
    return out


def manifest_path(output: str | Path, keyword: str) -> Path:
    return Path(output) / f"{keyword}.manifest.json"


def read_manifest(output: str | Path, keyword: str) -> dict:
    """The manifest, or an empty one where there is none that can be read."""
    try:
        found = json.loads(manifest_path(output, keyword).read_text("utf-8"))
        parts = [p for p in found["parts"] if isinstance(p["name"], str) and Path(p["name"]).name == p["name"]]
        return {**found, "parts": parts} if len(parts) == len(found["parts"]) else {}
    except (OSError, ValueError, KeyError, TypeError):
        return {}


def fingerprint(hits: bytes, source_root: str | Path, options: Options) -> str:
    """Hash of all that a keyword's rows follow from but the sources themselves."""
    try:
        stop = Path(options.stoplist).read_bytes() if options.stoplist else b""
    except OSError:
        stop = b""
    values = {name: getattr(options, name) for name in ("max_depth", "min_specificity", "include", "exclude", "follow_symlinks", "max_file_bytes", "max_symbols", "max_paths", "memory_limit_mb", "encoding_fallback", "fast_encoding")}
    values |= {"lang_map": sorted(options.lang_map.items()), "hits": hashlib.sha256(hits).hexdigest(), "stop": hashlib.sha256(stop).hexdigest(), "root": os.fspath(Path(source_root).resolve())}
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=list).encode()).hexdigest()


def is_complete(output: str | Path, keyword: str, expected: str, options: Options) -> bool:
    """Whether an earlier run with the same input and options left all of a keyword's parts as they were."""
    found = read_manifest(output, keyword)
    if not found or (found.get("format"), found.get("fingerprint"), found.get("encoding"), found.get("max_rows_per_part")) != (FORMAT, expected, options.output_encoding, options.max_rows_per_part):
        return False
    for part in found["parts"]:
        here = hashlib.sha256()
        try:
            with open(Path(output) / part["name"], "rb") as f:
                while piece := f.read(1 << 20):
                    here.update(piece)
        except OSError:
            return False
        if here.hexdigest() != part.get("sha256"):
            return False
    return bool(found["parts"])


def pending(spark: SparkSession, input_dir: str | Path, output: str | Path, source_root: str | Path, options: Options) -> tuple[dict[str, str], list[str]]:
    """Keywords to be done with their fingerprints, and those that a resumed run can leave out."""
    todo, done = {}, []
    for path in sorted(Path(input_dir).glob("*.grep")):
        mark = fingerprint(path.read_bytes(), source_root, options)
        if options.resume and is_complete(output, path.stem, mark, options):
            done.append(path.stem)
        else:
            todo[path.stem] = mark
    return todo, done
