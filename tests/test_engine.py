"""Whole runs over small trees: rows, parts, manifests, resumed runs and refused options."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell import __main__ as command
from tracewell import engine
from tracewell.operators import diagnostics
from tracewell.options import Options
from tracewell.sinks import tsv
from tracewell.sources import grep, walk
from tracewell.sources.kept import Kept, namespace
from tracewell.sources.staging import Tables


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/conf/set.sh": "LIMIT=9\necho $LIMIT\n",
        "src/use.sh": "NEXT=$LIMIT\nexport LAST=$NEXT\n",
        "src/q.sql": "SELECT a\nFROM t\nWHERE x = LIMIT;\n",
        "src/build/gone.sh": "A=$LIMIT\n",
        "src/odd": "#!/usr/bin/awk -f\nuse(LIMIT)\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "src/bin.dat").write_bytes(b"a\0b LIMIT")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/LIMIT.grep").write_bytes(b"conf/set.sh:1:LIMIT=9\r\nq.sql:3:WHERE x = LIMIT;\nno hit at all\nlost.sh:4:LIMIT\n../up.sh:1:x\nconf/set.sh:99999999999999999999:x\nodd:2:use(LIMIT)\n")
    (tmp_path / "in/NONE.grep").write_bytes(b"")
    return tmp_path


def cells(path):
    lines = path.read_text("utf-8-sig").split("\n")
    assert lines.pop() == "" and lines.pop(0).split("\t") == list(tsv.COLUMNS)
    return [dict(zip(tsv.COLUMNS, line.split("\t"))) for line in lines]


def test_run(spark, tree):
    out = tree / "out"
    engine.run(spark, tree / "in", out, tree / "src")
    rows = cells(out / "LIMIT.tsv")
    root = os.path.realpath(tree / "src")
    assert [(r["file"].removeprefix(root + "/"), r["lineno"], r["ref_kind"], r["chain"]) for r in rows] == [
        ("conf/set.sh", "1", "direct", "LIMIT@conf/set.sh:1"),
        ("conf/set.sh", "9223372036854775807", "direct", "LIMIT@conf/set.sh:9223372036854775807"),
        ("odd", "2", "direct", "LIMIT@odd:2"),
        ("q.sql", "3", "direct", "LIMIT@q.sql:3"),
        # a name's own line comes before the lines that it is found on next
        ("conf/set.sh", "2", "indirect:var", "LIMIT@conf/set.sh:1 -> LIMIT@conf/set.sh:2"),
        ("use.sh", "1", "indirect:var", "LIMIT@conf/set.sh:1 -> LIMIT@use.sh:1"),
        ("use.sh", "1", "indirect:var", "LIMIT@conf/set.sh:1 -> LIMIT@use.sh:1 -> NEXT@use.sh:1"),
        ("use.sh", "2", "indirect:var", "LIMIT@conf/set.sh:1 -> LIMIT@use.sh:1 -> NEXT@use.sh:2"),
        ("use.sh", "2", "indirect:var", "LIMIT@conf/set.sh:1 -> LIMIT@use.sh:1 -> NEXT@use.sh:2 -> LAST@use.sh:2"),
    ]
    assert rows[1]["snippet"] == "" and rows[3]["snippet"].startswith("FROM t \\n WHERE") and rows[3]["category"] != ""
    assert cells(out / "NONE.tsv") == []
    summary = (out / "diagnostics.txt").read_text().split("# detail")[0].split("\n")[1:-1]
    counts = dict(x.split("\t") for x in summary)
    assert counts["bad_grep_line"] == "1" and counts["missing_source"] == "2" and counts["walk_skipped_binary"] == "1" and counts["walk_excluded"] == "1" and counts["unsupported_shebang"] == "1"


def test_parts_and_resume(spark, tree):
    out, few = tree / "out", Options(max_rows_per_part=2, resume=True)
    first = engine.run(spark, tree / "in", out, tree / "src", few)
    parts = [p["name"] for p in first[0]["parts"]]
    assert parts[0] == "LIMIT.part01.tsv" and len(parts) > 2
    joined = [r for name in parts for r in cells(out / name)]
    assert len(joined) == first[0]["rows"] and all(len(cells(out / n)) == 2 for n in parts[:-1])
    stamps = {n: (out / n).stat().st_mtime_ns for n in parts}
    assert engine.run(spark, tree / "in", out, tree / "src", few) == []
    assert stamps == {n: (out / n).stat().st_mtime_ns for n in parts}
    assert "resume_skipped\t2" in (out / "diagnostics.txt").read_text()
    # a changed part, then other options
    (out / parts[0]).write_text("else")
    assert [m["keyword"] for m in engine.run(spark, tree / "in", out, tree / "src", few)] == ["LIMIT"]
    again = engine.run(spark, tree / "in", out, tree / "src", Options(resume=True))
    assert [m["keyword"] for m in again] == ["LIMIT", "NONE"] and cells(out / "LIMIT.tsv") == joined
    assert not any((out / n).exists() for n in parts)


def test_lossy_encoding_stays_complete(spark, tree):
    (tree / "src/conf/set.sh").write_text("LIMIT=9 # 😀\n")
    odd = Options(output_encoding="latin-1", resume=True)
    engine.run(spark, tree / "in", tree / "out", tree / "src", odd)
    assert b"?" in (tree / "out/LIMIT.tsv").read_bytes() and engine.run(spark, tree / "in", tree / "out", tree / "src", odd) == []


def test_fingerprint_follows_what_decides_rows(tree):
    mark = lambda hits=b"a", **k: tsv.fingerprint(hits, tree, Options(**k))
    assert mark() == mark(resume=True) == mark(diagnostics_detail_limit=3)
    assert len({mark(), mark(b"b"), mark(max_depth=3), mark(lang_map={".x": "c"}), mark(exclude=[])}) == 5
    (tree / "out").mkdir()
    (tree / "out/K.manifest.json").write_text(json.dumps({"parts": [{"name": "../x"}]}))
    assert tsv.read_manifest(tree / "out", "K") == {} and not tsv.is_complete(tree / "out", "K", "", Options())


@pytest.mark.parametrize("more", [["--max-depth", "-1"], ["--lang-map", "x"], ["--output-encoding", "nope"], ["--jobs", "0"], ["--stoplist", "/none"], ["--max-symbols", "0"]])
def test_command_line_refuses(tree, more, capsys):
    with pytest.raises(SystemExit):
        command.main(["--input", str(tree / "in"), "--output", str(tree / "out"), "--source-root", str(tree / "src"), *more])
    with pytest.raises(SystemExit):
        command.main(["--input", str(tree / "in"), "--output", str(tree / "src"), "--source-root", str(tree / "src")])
    assert "--output" in capsys.readouterr().err and not (tree / "out").exists()


def test_command_line_options():
    given = command.parser().parse_args("--input a --output b --source-root c --memory-limit 0 --min-specificity 0 --lang-map .inc=c --exclude x --encoding-fallback euc-jp,latin-1".split())
    options = command.options_of(given)
    assert (options.items, options.min_specificity, options.lang_map, options.exclude, options.encoding_fallback) == (0, 0, {".inc": "c"}, ["x"], ("euc-jp", "latin-1")) and options.problems() == []


def test_linked_folders_are_entered_once_in_order(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "z/x.c").write_text("x")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/link").symlink_to("../z")
    files, _ = walk.walk(spark, tmp_path, Options(follow_symlinks=True), Tables(spark, "walk"))
    assert [f["relpath"] for f in files.collect()] == ["a/link/x.c"]
    files, notes = walk.walk(spark, tmp_path, Options(), Tables(spark, "walk"))
    assert [f["relpath"] for f in files.collect()] == ["z/x.c"] and notes.isEmpty()


def test_folders_left_are_dealt_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "LISTED", 2)
    names = [f"{a}/{b}/{c}.c" for a in "pq" for b in "rst" for c in "uv"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "p/l").symlink_to("r/u.c")
    files, notes = walk.walk(spark, tmp_path, Options(), Tables(spark, "walk"))
    assert {r["relpath"]: bytes(r["content"]).decode() for r in walk.read(files).collect()} == {n: n for n in names}
    assert [tuple(r)[:2] for r in notes.collect()] == [("symlink_skipped", "p/l")]
    empty = tmp_path / "none"
    empty.mkdir()
    files, notes = walk.walk(spark, empty, Options(), Tables(spark, "walk"))
    assert walk.read(files).isEmpty() and notes.isEmpty()


def test_kept_texts_give_the_same_rows(spark, tree, monkeypatch):
    (tree / "src/jp.sh").write_bytes("X=$LIMIT # 日本語のコード\n".encode("cp932"))
    store = tree / "kept"
    plain = engine.run(spark, tree / "in", tree / "out0", tree / "src")
    options = Options(decode_cache_dir=str(store))
    engine.run(spark, tree / "in", tree / "out1", tree / "src", options)
    texts = Kept(spark, str(store), options).texts()
    assert texts.where("encoding = 'shift_jis'").count() == 1 and texts.count() == 5
    monkeypatch.setattr(engine, "decoded", lambda *_: F.raise_error(F.lit("decoded again")).cast("struct<text: string, encoding: string, replaced: boolean>"))
    again = engine.run(spark, tree / "in", tree / "out2", tree / "src", options)
    monkeypatch.undo()
    assert [m["rows"] for m in again] == [m["rows"] for m in plain]
    assert all((tree / "out0/LIMIT.tsv").read_bytes() == (tree / o / "LIMIT.tsv").read_bytes() for o in ("out1", "out2"))
    # a changed file and another way to decode are misses; an unfinished run isn't read
    (tree / "src/q.sql").write_text("SELECT 1;\n")
    next(store.glob("*/*/_SUCCESS")).unlink()
    engine.run(spark, tree / "in", tree / "out3", tree / "src", options)
    assert Kept(spark, str(store), options).texts().where("text = 'SELECT 1;\n'").count() == 1
    other = Options(decode_cache_dir=str(store), fast_encoding=True)
    assert namespace(other) != namespace(options) and Kept(spark, str(store), other).texts().isEmpty()
    Kept(spark, str(store), options).trim(1)
    assert Kept(spark, str(store), options).texts().isEmpty()


def test_keywords_stop_words_caps_and_getters(spark, tree):
    (tree / "src/Conf.java").write_text("class Conf {\n  void run() {\n    svc.setLimit(LIMIT);\n  }\n}\n")
    (tree / "src/Use.java").write_text("class Use {\n  int a = conf.setLimit(3);\n  int b = a + 1;\n}\n")
    (tree / "in/LIMIT.grep").write_bytes(b"conf/set.sh:1:LIMIT=9\nConf.java:3:    svc.setLimit(LIMIT);\n")
    (tree / "in/NEXT.grep").write_bytes(b"use.sh:1:NEXT=$LIMIT\n")
    (tree / "stop").write_text("# names\n\nLAST\n")

    def run(name, **more):
        found = engine.run(spark, tree / "in", tree / name, tree / "src", Options(**more))
        notes = [tuple(line.split("\t", 1)) for line in (tree / name / "diagnostics.txt").read_text().split("# detail\n")[1].splitlines()]
        return {m["keyword"]: {(r["via_symbol"], r["lineno"], r["ref_kind"]) for r in cells(tree / name / f"{m['keyword']}.tsv")} for m in found}, notes

    rows, notes = run("plain")
    assert {s for s, *_ in rows["NEXT"]} == {"", "NEXT", "LAST"} and {s for s, *_ in rows["LIMIT"]} >= {"", "LIMIT", "NEXT", "LAST"}
    assert not [m for c, m in notes if c == "symbol_rejected" and "user_stoplist" in m]
    assert ("getter_setter_no_expand", "setLimit") in notes and ("setLimit", "2", "indirect:setter") in rows["LIMIT"]
    assert "a" not in {s for s, *_ in rows["LIMIT"]}
    stopped, notes = run("stopped", stoplist=tree / "stop")
    assert {s for s, *_ in stopped["NEXT"]} == {"", "NEXT"} and ("symbol_rejected", "user_stoplist\tLAST") in notes
    capped, _ = run("capped", max_symbols=1)
    assert {s for s, *_ in capped["NEXT"]} == {"", "NEXT"}
    none, _ = run("none", memory_limit_mb=0)
    assert {s for s, *_ in none["NEXT"]} == {""}


def test_hits_with_large_numbers(spark):
    rows = spark.createDataFrame([("a.c:99999999999:x",), ("b:2:",), ("c",)], "hit string")
    assert [(r["path"], r["lineno"]) for r in grep.parse(rows, "hit").collect()] == [("a.c", 99999999999), ("b", 2), (None, None)]


def test_diagnostics_text(spark):
    rows = spark.createDataFrame([("b", f"m{k}", k) for k in range(5)] + [("symbol_rejected", f"s{k}", k) for k in range(4)], "category string, message string, seq long")
    assert diagnostics.render(rows, 2) == "# summary\nb\t5\nsymbol_rejected\t4\n# detail\nb\tm0\nb\tm1\nb\t(... 3 more, 5 total)\nsymbol_rejected\ts0\nsymbol_rejected\ts1\nsymbol_rejected\ts2\nsymbol_rejected\ts3\n"
