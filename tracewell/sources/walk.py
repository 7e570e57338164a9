"""Files of a source tree, on a file system that the driver and the executors share."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.text import glob_regex
from ..options import Options
from .staging import Tables

ENTRIES = "what string, path binary"
JUDGED = "kind string, relpath string, place binary, path binary, size long, mtime_ns long, real string"
#: Folders that a task lists before the rest is dealt again.
LISTED = 2000
#: Bytes of files that a task holds, and that a task reads.
HELD_BYTES, TASK_BYTES = 32 << 20, 128 << 20
#: A file with one of these marks at its start is text that a byte search can't judge.
WIDE_MARKS = (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff", b"\xff\xfe", b"\xfe\xff")
HEAD = 65536


def shown(path: bytes | str) -> str:
    """A path as text; bytes that aren't UTF-8 are written out, since a column can't hold them."""
    raw = os.fsencode(path)
    return raw.decode("utf-8", "backslashreplace")


def kind_of(head: bytes) -> str:
    """unsafe (marked as UTF-16 or 32), binary (a NUL in its head) or ok."""
    return "unsafe" if head.startswith(WIDE_MARKS) else "binary" if b"\x00" in head else "ok"


def _list(root: str, folder: bytes, follow: bool) -> tuple[list[bytes], list[bytes], list[bytes]] | None:
    """Paths below ``root`` of a folder's folders, files and links that are left out, or None if it can't be read."""
    try:
        entries = sorted(os.scandir(os.path.join(os.fsencode(root), folder)), key=lambda e: e.name)
    except OSError:
        return None
    folders, files, links = [], [], []
    for entry in entries:
        path = folder + b"/" + entry.name if folder else entry.name
        if entry.is_dir():
            if follow or not entry.is_symlink():
                folders.append(path)
        else:
            (links if entry.is_symlink() and not follow else files).append(path)
    return folders, files, links


def _one_by_one(root: str) -> Iterator[tuple[str, bytes]]:
    """(what, path) of a tree whose links are followed: a folder is entered once, by the first of its paths."""
    entered, todo = set(), [b""]
    while todo:
        folder = todo.pop()
        real = os.path.realpath(os.path.join(os.fsencode(root), folder))
        if real in entered:
            continue
        entered.add(real)
        listed = _list(root, folder, True)
        if listed is None:
            yield "unreadable", folder
            continue
        todo += listed[0][::-1]
        yield from (("file", path) for path in listed[1])


def _entries(spark: SparkSession, root: str, options: Options, tables: Tables) -> DataFrame:
    """(what, path) of all files and of what is left out, listed by the executors.

    A task lists ``LISTED`` folders and hands on those that it has found and not entered; these are dealt
    again. Followed links are listed on the driver, since the order decides who enters a folder.
    """
    if options.follow_symlinks:
        return tables.put(spark.createDataFrame([(w, bytearray(p)) for w, p in _one_by_one(root)], ENTRIES), "entries")

    def work(batches):
        for batch in batches:
            todo, left, out = [bytes(p) for p in batch["path"]][::-1], LISTED, []
            while todo and left:
                folder, left = todo.pop(), left - 1
                listed = _list(root, folder, False)
                if listed is None:
                    out.append(("unreadable", folder))
                    continue
                todo += listed[0][::-1]
                out += [("file", path) for path in listed[1]] + [("link", path) for path in listed[2]]
                if len(out) >= LISTED:
                    yield pd.DataFrame(out, columns=["what", "path"])
                    out = []
            yield pd.DataFrame(out + [("folder", path) for path in todo], columns=["what", "path"])

    every, folders = None, spark.createDataFrame([(bytearray(b""),)], "path binary")
    while True:
        rows = tables.put(folders.mapInPandas(work, ENTRIES), f"entries{tables.count}")
        every = rows if every is None else every.unionByName(rows)
        folders = rows.where("what = 'folder'").select("path")
        n = folders.count()
        if not n:
            return every.where("what <> 'folder'")
        folders = folders.repartition(min(n, spark.sparkContext.defaultParallelism * 4))


def _place(path: bytes) -> bytes:
    """The order in which a walk meets paths: a folder's files, then its folders."""
    *above, name = path.split(b"/")
    return b"".join(b"\x02" + x + b"\x00" for x in above) + b"\x01" + name


def walk(spark: SparkSession, root: str | Path, options: Options, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Files to search (relpath, path, size, mtime_ns, real, kind), and notes (category, message, place).

    ``place`` orders the notes of a category. Of several paths to one file the first is taken. A path
    whose bytes aren't UTF-8 is shown with them written out; ``path`` is the absolute one, as bytes.
    """
    root = os.path.realpath(root)
    include, exclude = ([re.compile("(?s)" + glob_regex(g)) for g in globs] for globs in (options.include, options.exclude))
    most = options.max_file_bytes

    def judge(what: str, below: bytes) -> tuple | None:
        relpath, path = shown(below), os.path.join(os.fsencode(root), below)
        note = lambda category, place=below: (category, relpath, place, None, None, None, None)
        if what != "file":
            return note("symlink_skipped" if what == "link" else "walk_unreadable", _place(below))
        if any(p.search(relpath) for p in exclude):
            return note("walk_excluded", _place(below))
        if include and not any(p.search(relpath) for p in include):
            return None
        try:
            info = os.stat(path)
            if not stat.S_ISREG(info.st_mode):
                return note("walk_skipped_special")
            if info.st_size > most:
                return note("walk_skipped_large")
            with open(path, "rb") as f:
                kind = kind_of(f.read(HEAD))
        except OSError:
            return note("walk_unreadable")
        if kind == "binary":
            return note("walk_skipped_binary")
        return kind, relpath, below, path, info.st_size, info.st_mtime_ns, shown(os.path.realpath(path))

    def work(batches):
        for batch in batches:
            rows = [r for r in map(judge, batch["what"], map(bytes, batch["path"])) if r is not None]
            yield pd.DataFrame(rows, columns=["kind", "relpath", "place", "path", "size", "mtime_ns", "real"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    found = _entries(spark, root, options, tables).repartition(spark.sparkContext.defaultParallelism * 4)
    found = tables.put(found.mapInPandas(work, JUDGED), "judged")
    notes = found.where("path is null").select(F.col("kind").alias("category"), F.col("relpath").alias("message"), "place")
    files = found.where("path is not null")
    if options.follow_symlinks:  # without links no two paths lead to one file
        files = files.withColumn("first", F.min(F.struct("place", "relpath")).over(Window.partitionBy("real")))
        again = files.where("place <> first.place")
        notes = notes.unionByName(again.select(F.lit("symlink_dedup").alias("category"), F.concat("relpath", F.lit(" -> "), "first.relpath").alias("message"), "place"))
        files = files.where("place = first.place")
    return files.select("relpath", "path", "size", "mtime_ns", "real", "kind"), notes


def named(paths: DataFrame, root: str | Path) -> DataFrame:
    """The files of ``walk`` for names (relpath, path) that lie below ``root``, whatever the walk leaves out."""
    root = os.fsencode(os.path.realpath(root))

    def work(batches):
        for batch in batches:
            rows = []
            for relpath, path in zip(batch["relpath"], batch["path"]):
                path = bytes(path)
                if not path or path.startswith(b"/") or b"\x00" in path or b".." in path.split(b"/"):
                    continue
                whole = os.path.join(root, path)
                try:
                    real = os.path.realpath(whole)
                    if os.path.commonpath([root, real]) == root and os.path.isfile(whole):
                        info = os.stat(whole)
                        with open(whole, "rb") as f:
                            rows.append((relpath, whole, info.st_size, info.st_mtime_ns, shown(real), kind_of(f.read(HEAD))))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["relpath", "path", "size", "mtime_ns", "real", "kind"])

    return paths.select("relpath", "path").mapInPandas(work, "relpath string, path binary, size long, mtime_ns long, real string, kind string")


def read(files: DataFrame) -> DataFrame:
    """``files`` with their content, read by the executors ``TASK_BYTES`` a task or less.

    ``size`` and ``mtime_ns`` become those of the open file; a file gone since the walk is empty and
    has neither.
    """
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    names = files.columns

    def load(batches):
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_dict("records"):
                row.update(size=None, mtime_ns=None, content=b"")
                try:
                    with open(bytes(row["path"]), "rb") as f:
                        info = os.fstat(f.fileno())
                        row.update(size=info.st_size, mtime_ns=info.st_mtime_ns, content=f.read())
                except OSError:
                    pass
                rows.append(row)
                held += len(row["content"])
                if held >= HELD_BYTES:
                    yield _frame(rows)
                    rows, held = [], 0
            yield _frame(rows)

    def _frame(rows):
        return pd.DataFrame(rows, columns=[*names, "content"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    dealt = files.repartition(max(spark.sparkContext.defaultParallelism * 4, total // TASK_BYTES))
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])
    return dealt.mapInPandas(load, schema)
