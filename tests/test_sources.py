import os

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.options import Options, parse_lang_map
from tracewell.sources import decode, grep, walk
from tracewell.sources.staging import Tables


def test_hits_part_at_the_leftmost_number(spark):
    rows = spark.createDataFrame([("a.c:12:x:3:y",), ("C:/b.c:7:",), ("no hit",), ("",), (None,), ("d:1:z\r\n",)], "h string")
    found = [(r["path"], r["lineno"], r["content"]) for r in grep.parse(rows, "h").collect()]
    assert found == [("a.c", 12, "x:3:y"), ("C:/b.c", 7, ""), (None, None, None), (None, None, None), (None, None, None), ("d", 1, "z")]


def walked(spark, tmp_path, options):
    """(relpath, kind) of the files by path, and (category, message) of the notes."""
    files, notes = walk.walk(spark, tmp_path, options, Tables(spark, "walk"))
    return sorted((r["relpath"], r["kind"]) for r in files.collect()), [(r["category"], r["message"]) for r in notes.orderBy("category", "place").collect()]


def test_walk_leaves_out_what_it_notes(spark, tmp_path):
    for name, data in {"a.c": b"x", "b/c.h": b"y", "target/d.c": b"z", "n.bin": b"a\0b", "w.txt": b"\xff\xfea\0", "big.c": b"x" * 50}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "a.c", tmp_path / "link.c")
    files, notes = walked(spark, tmp_path, Options(max_file_bytes=20))
    assert files == [("a.c", "ok"), ("b/c.h", "ok"), ("w.txt", "unsafe")]
    assert sorted(notes) == [("symlink_skipped", "link.c"), ("walk_excluded", "target/d.c"), ("walk_skipped_binary", "n.bin"), ("walk_skipped_large", "big.c")]
    files, notes = walked(spark, tmp_path, Options(follow_symlinks=True, include=["*.c"]))
    assert [f[0] for f in files] == ["a.c", "big.c"] and ("symlink_dedup", "link.c -> a.c") in notes


def test_files_are_read_and_decoded(spark, tmp_path):
    (tmp_path / "u.txt").write_text("é", "utf-8")
    (tmp_path / "s.txt").write_bytes("日本語のコード".encode("cp932"))
    (tmp_path / "e.txt").write_bytes(b"")
    (tmp_path / "w.txt").write_bytes("wïde".encode("utf-16"))
    (tmp_path / "v.txt").write_bytes("wïde".encode("utf-32"))
    files, _ = walk.walk(spark, tmp_path, Options(), Tables(spark, "walk"))
    rows = walk.read(files).select("relpath", decode.decoded(F.col("content"), ("cp932", "latin-1")).alias("d")).collect()
    assert {r["relpath"]: tuple(r["d"]) for r in rows} == {"u.txt": ("é", "utf-8", False), "s.txt": ("日本語のコード", "shift_jis", False), "e.txt": ("", "utf-8", False), "w.txt": ("wïde", "utf-16", False), "v.txt": ("wïde", "utf-32", False)}


@pytest.mark.parametrize(("glob", "path", "found"), [("*.c", "a/b.c", True), ("a/*.c", "a/b/c.c", False), ("**/x/**", "x/y", True), ("a?[0-2].c", "ab1.c", True), ("a[!b].c", "ab.c", False)])
def test_globs(spark, glob, path, found):
    assert spark.range(1).select(X.matches_any(F.lit(path), [glob])).first()[0] is found


def test_options_say_what_is_wrong():
    assert Options().problems() == [] and len(Options(max_paths=0, output_encoding="none").problems()) == 2
    assert parse_lang_map("TPL=html, .x=c") == {".tpl": "html", ".x": "c"}
    with pytest.raises(ValueError):
        parse_lang_map("x")


def test_cells(spark):
    row = spark.createDataFrame([("=a\tb", None)], "a string, b string").select(X.neutralize(X.sanitize(F.col("a"))), X.sanitize(F.col("b")), X.contained(F.col("b"))).first()
    assert tuple(row) == ("'=a b", None, False)
