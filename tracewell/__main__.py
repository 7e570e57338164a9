"""Command line: ``spark-submit tracewell/__main__.py --input ... --output ... --source-root ...``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracewell.options import Options, folder_problems, parse_lang_map  # noqa: E402


def parser() -> argparse.ArgumentParser:
    base, out = Options(), argparse.ArgumentParser(prog="tracewell", description="Explain how keywords are used across a source tree.")
    for name, text in (("input", "folder of <keyword>.grep files with lines path:lineno:content"), ("output", "folder for rows, manifests and diagnostics"), ("source-root", "root of the tree that the paths are below")):
        out.add_argument(f"--{name}", required=True, help=text)
    numbers = {"max-depth": "hops that names are followed", "min-specificity": "shortest name that is followed", "max-file-bytes": "largest file of the walk", "max-symbols": "names followed a keyword", "max-paths": "chains a place", "memory-limit": "MB that bound the names followed", "max-rows-per-part": "rows of a file", "diagnostics-detail-limit": "messages listed a category, 0 for all"}
    for name, text in numbers.items():
        out.add_argument(f"--{name}", type=int, default=getattr(base, "memory_limit_mb" if name == "memory-limit" else name.replace("-", "_")), help=text)
    out.add_argument("--stoplist", type=Path, help="file of names that are not followed")
    out.add_argument("--lang-map", default="", help="languages by extension, .ext=language,...")
    out.add_argument("--include", action="append", default=[], help="glob of files to search; may be repeated")
    out.add_argument("--exclude", action="append", help="glob of files to leave out; may be repeated, replaces the default")
    out.add_argument("--output-encoding", default=base.output_encoding)
    out.add_argument("--encoding-fallback", default=",".join(base.encoding_fallback), help="encodings tried after UTF-8 and a guess")
    for name, text in (("follow-symlinks", "enter linked folders and files"), ("fast-encoding", "try the fallbacks before guessing"), ("resume", "leave out keywords that are done")):
        out.add_argument(f"--{name}", action="store_true", help=text)
    out.add_argument("--decode-cache-dir", help="folder for decoded texts that later runs use")
    out.add_argument("--decode-cache-max-bytes", type=int, help="size beyond which the oldest of them go")
    out.add_argument("--jobs", type=int, default=1, help="least number of tasks of a stage; the rows are the same for any")
    # accepted for existing scripts; they have no effect on the rows, nor on Spark's plans
    for name in ("ripgrep-threshold-bytes", "max-passes"):
        out.add_argument(f"--{name}", type=int, help="has no effect")
    out.add_argument("--progress", help="has no effect")
    for name in ("use-ripgrep", "no-use-ripgrep", "no-perkw-diag"):
        out.add_argument(f"--{name}", action="store_true", help="has no effect")
    return out


def options_of(given: argparse.Namespace) -> Options:
    more = {} if given.exclude is None else {"exclude": given.exclude}
    fallback = tuple(x.strip() for x in given.encoding_fallback.split(",") if x.strip()) or Options().encoding_fallback
    same = ("max_depth", "min_specificity", "stoplist", "include", "follow_symlinks", "max_file_bytes", "max_symbols", "max_paths", "resume", "output_encoding", "max_rows_per_part", "diagnostics_detail_limit", "fast_encoding", "decode_cache_dir", "decode_cache_max_bytes")
    return Options(**{n: getattr(given, n) for n in same}, lang_map=parse_lang_map(given.lang_map), memory_limit_mb=given.memory_limit, encoding_fallback=fallback, **more)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    given = p.parse_args(argv)
    try:
        options = options_of(given)
    except ValueError as e:
        p.error(str(e))
    problems = [*folder_problems(given.input, given.output, given.source_root), *options.problems()]
    problems += [f"--{name.replace('_', '-')} must be {least} or more" for name, least in (("jobs", 1), ("max_passes", 1), ("ripgrep_threshold_bytes", 0)) if (v := getattr(given, name)) is not None and v < least]
    if problems:
        p.error("; ".join(problems))
    from pyspark.sql import SparkSession

    from tracewell import engine

    root = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    spark = SparkSession.builder.appName("tracewell").config("spark.default.parallelism", max(given.jobs, 1)).getOrCreate() if given.jobs > 1 else SparkSession.builder.appName("tracewell").getOrCreate()
    engine.run(spark, given.input, given.output, given.source_root, options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
