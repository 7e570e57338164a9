"""A whole run: search hits and a source tree in, rows of direct and indirect uses out."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import languages as L
from .functions import text as X
from .functions import trees
from .operators import diagnostics, index, snippets
from .options import Options, folder_problems
from .plans import closure as C
from .plans import paths as P
from .sinks import tsv
from .sources import grep, walk
from .sources.decode import decoded
from .sources.kept import KEY, Kept
from .sources.staging import Tables

# --- fixed value: what an encoding that was guessed or replaced is marked with
REVIEW = " 要確認"


@dataclass
class Analysis:
    """``rows`` with the columns of ``tsv.COLUMNS``; ``notes``: category, message, seq."""

    rows: DataFrame
    notes: DataFrame


def load(spark: SparkSession, root: str | Path, hits: DataFrame, options: Options, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Decoded files (relpath, text, encoding, replaced, language, dialect, walked), and notes of the walk.

    The files that the walk finds, and those that hits name although it leaves them out. Texts kept from
    earlier runs aren't read again.
    """
    walked, notes = walk.walk(spark, root, options, tables)
    named = hits.where("path is not null").select("relpath", "path").distinct().join(walked.select("relpath"), "relpath", "left_anti")
    files = walked.withColumn("walked", F.lit(True)).unionByName(walk.named(named, root).withColumn("walked", F.lit(False)))
    files = _texts(spark, tables.put(files, "found"), options, tables)
    path, text = F.col("relpath"), F.col("text")
    files = files.withColumn("language", L.detect_language(path, text, options.lang_map)).withColumn("dialect", L.detect_dialect(path, text))
    odd = ~L.resolved_by_name(path, options.lang_map) & L.interpreter(F.substring(text, 1, 65536)).isNotNull() & L.shebang_language(F.substring(text, 1, 65536)).isNull()
    return tables.put(files.withColumn("odd_shebang", F.coalesce(odd, F.lit(False))), "files"), notes


def _texts(spark: SparkSession, files: DataFrame, options: Options, tables: Tables) -> DataFrame:
    """(relpath, walked, text, encoding, replaced) of ``files``, read and decoded unless kept."""

    def fresh(some: DataFrame) -> DataFrame:
        read = walk.read(some).withColumn("d", decoded(F.col("content"), options.encoding_fallback, options.fast_encoding))
        return read.select("relpath", "walked", *KEY, "d.text", "d.encoding", "d.replaced")

    columns = ["relpath", "walked", "text", "encoding", "replaced"]
    if options.decode_cache_dir is None:
        return fresh(files).select(*columns)
    kept = Kept(spark, options.decode_cache_dir, options)
    known = kept.texts()
    had = tables.put(files.join(known, KEY).select(*columns), "kept")
    made = tables.put(fresh(files.join(known.select(*KEY), KEY, "left_anti")), "decoded")
    kept.add(made)
    if options.decode_cache_max_bytes is not None:
        kept.trim(options.decode_cache_max_bytes)
    return had.unionByName(made.select(*columns))


CONSTRUCTS = "relpath string, language string, lineno int, category string, confidence string, first int, last int, names array<struct<symbol: string, kind: string>>"


def constructs(files: DataFrame) -> DataFrame:
    """What the lines of files (relpath, language, text) stand in, for languages that are read as a whole."""

    def run(batches):
        for batch in batches:
            for relpath, language, text in zip(*(batch.column(c).to_pylist() for c in ("relpath", "language", "text"))):
                rows = [(relpath, language, *r[:5], [{"symbol": a, "kind": b} for a, b in r[5]]) for r in trees.describe(language, text or "")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = ["relpath", "language", "lineno", "category", "confidence", "first", "last", "names"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("symbol", pa.string()), ("kind", pa.string())]))]
    schema = pa.schema(list(zip(names, kinds)))
    whole = files.where(F.col("language").isin(*trees.TREES)).select("relpath", "language", "text")
    return whole.mapInArrow(run, CONSTRUCTS)


def _names(lines: DataFrame, made: DataFrame, options: Options) -> DataFrame:
    """(relpath, lineno, symbol, kind, ord, why): the names that lines bind, and why one isn't followed."""
    bound = lines.withColumn("b", L.bound_names_of(F.col("language"), F.col("dialect"), F.col("line")))
    of = lambda group, kind: F.transform(f"b.{group}", lambda x: F.struct(x.alias("symbol"), F.lit(kind).alias("kind")))
    each = F.concat(of("constants", "constant"), of("vars", "var"))
    found = bound.select("relpath", "lineno", "language", F.posexplode(each).alias("ord", "x")).unionByName(made.select("relpath", "lineno", "language", F.posexplode("names").alias("ord", "x")))
    found = found.select("relpath", "lineno", "x.symbol", "x.kind", "ord", "language")
    return found.withColumn("why", L.rejection(F.col("symbol"), F.col("language"), options.min_specificity, options.stop_words())).drop("language")


def _classed(places: DataFrame, made: DataFrame, content: Column) -> DataFrame:
    """``places`` with c: the class of the construct that the line stands in, or of the line itself."""
    whole = made.select("relpath", F.col("lineno").cast("long").alias("lineno"), F.struct("category", "confidence").alias("whole"))
    alone = L.classify_line(F.col("language"), F.col("dialect"), content)
    past = F.struct(F.lit(trees.OTHER).alias("category"), F.lit("high").alias("confidence"))  # beyond the last line
    return places.join(whole, ["relpath", "lineno"], "left").withColumn("c", F.coalesce("whole", F.when(F.col("language").isin(*trees.TREES), past).otherwise(alone))).drop("whole")


def analyse(spark: SparkSession, hits: DataFrame, source_root: str | Path, options: Options, tables: Tables) -> Analysis:
    """Direct and indirect uses of the keywords of ``hits`` (as ``grep.read`` gives them)."""
    files, walk_notes = load(spark, source_root, hits, options, tables)
    meta = files.drop("text")
    lines = index.lines(files, "language", "dialect", "walked")
    lines = tables.put(lines, "lines")
    good = hits.where("relpath is not null").join(meta, "relpath", "left")
    good = tables.put(good, "hits")

    made = tables.put(constructs(files), "constructs")

    # direct uses: the class of what the hit says, at its place in the file
    here = _classed(good.where("language is not null"), made, F.col("content"))
    direct = here.select("keyword", "language", "dialect", "relpath", "lineno", F.lit("direct").alias("ref_kind"), "c.category", F.lit("").alias("via_symbol"), X.hop(F.col("keyword"), F.col("relpath"), F.col("lineno")).alias("chain"), "encoding", "replaced", "c.confidence")

    # indirect uses: names that those lines bind, followed through the tree
    names = tables.put(_names(lines, made, options), "names")
    seeds = here.select("keyword", "ord", "relpath", F.col("lineno").try_cast("int").alias("lineno")).where("lineno is not null")
    searched = lines.where("walked")
    found = C.follow(seeds, searched, index.token_index(searched), names.where("why is null"), options.max_depth, options.max_symbols, options.items)
    nodes = seeds.select("keyword", F.struct(F.col("keyword").alias("symbol"), "relpath", "lineno").alias("node"))
    chains = tables.put(P.first_chains(C.edges(found), nodes, options.max_depth, options.max_paths), "chains")
    targets = chains.select("keyword", "target.symbol", "target.relpath", "target.lineno", "chain").join(seeds.select("keyword", "relpath", "lineno").distinct(), ["keyword", "relpath", "lineno"], "left_anti")
    targets = targets.join(C.kinds(found), ["keyword", "symbol"]).join(lines.select("relpath", "lineno", "line"), ["relpath", "lineno"]).join(meta, "relpath")
    targets = _classed(targets, made, F.col("line"))
    indirect = targets.select("keyword", "language", "dialect", "relpath", F.col("lineno").cast("long").alias("lineno"), F.concat(F.lit("indirect:"), "kind").alias("ref_kind"), "c.category", F.col("symbol").alias("via_symbol"), "chain", "encoding", "replaced", F.when(F.col("kind").isin("getter", "setter"), "low").otherwise(F.col("c.confidence")).alias("confidence"))
    uses = tables.put(direct.unionByName(indirect), "uses")

    # a cell of lines for each place once, whatever the number of its rows
    ends = F.col("text").endswith("\n")
    last = files.select("relpath", F.when(ends, F.size(F.split("text", "\n", -1)) - 1).otherwise(F.size(F.split("text", "\n", -1))).alias("n"))
    physical = lines.join(last, "relpath").where("lineno <= n").select("relpath", "language", F.col("lineno").cast("long").alias("lineno"), "line", L.is_stop(F.col("language"), F.col("line")).alias("stop"))
    spans = made.select("relpath", F.col("lineno").cast("long").alias("lineno"), (F.col("first") + 1).cast("long").alias("from"), (F.col("last") + 1).cast("long").alias("to"))
    cells = snippets.snippets_of(uses, physical, spans)
    root = str(Path(source_root).resolve())
    rows = uses.join(cells, ["relpath", "lineno"], "left").select(
        "keyword", "language", F.concat(F.lit(root + "/"), "relpath").alias("file"), "lineno", "ref_kind", "category", F.lit("").alias("category_sub"), X.usage_summary(F.col("category"), F.col("language")).alias("usage_summary"),
        "via_symbol", "chain", F.coalesce("snippet", F.lit("")).alias("snippet"), F.concat("encoding", F.when(F.col("replaced"), REVIEW).otherwise("")).alias("encoding"), "confidence",
    )
    return Analysis(rows, tables.put(_notes(spark, hits, good, found, chains, names, seeds, walk_notes, options), "notes"))


def _notes(spark, hits, good, found: C.Closure, chains, names, seeds, walk_notes, options: Options) -> DataFrame:
    """What a reader of the results should know: the walk first, then by keyword, hits before what follows from them."""
    rows = [walk_notes.select("category", "message", F.lit("").alias("keyword"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("at"), "place")]
    say = lambda df, category, message, step, at="ord", place=F.lit(b""): rows.append(df.select(F.lit(category).alias("category"), message.alias("message"), "keyword", F.lit(step).alias("step"), F.col(at).cast("long").alias("at"), place.alias("place")))
    path = X.sanitize(F.col("relpath"))
    say(hits.where("relpath is null"), "bad_grep_line", F.concat("keyword", F.lit(".grep: "), "raw"), 1)
    say(good.where("language is null"), "missing_source", path, 1)
    say(good.where("replaced"), "decode_replaced", path, 1)
    say(good.where("odd_shebang"), "unsupported_shebang", path, 1)
    parents = seeds.select("keyword", "relpath", "lineno").unionByName(found.found.where("chase and not terminal").select("keyword", "relpath", "lineno"))
    refused = parents.join(names.where("why is not null"), ["relpath", "lineno"]).withColumn("at", F.lit(0))
    say(refused, "symbol_rejected", F.concat_ws("\t", "why", "symbol"), 2, "at")
    ends = found.found.where("terminal").groupBy("keyword", "symbol").agg(F.min(F.struct("hop", "relpath", "lineno")).alias("first"))
    say(ends, "getter_setter_no_expand", F.col("symbol"), 2, "first.hop", F.encode("first.relpath", "utf-8"))
    deep = found.beyond.distinct().withColumn("at", F.lit(0))
    node = X.hop(F.col("parent.symbol"), F.col("parent.relpath"), F.col("parent.lineno"))
    say(deep, "prov_max_depth", F.concat(node, F.lit(f" (hop {options.max_depth + 1} > --max-depth {options.max_depth})")), 2, "at")
    cut = chains.where("capped").select("keyword", "target").distinct().withColumn("at", F.lit(0))
    say(cut, "prov_path_capped", F.concat(X.hop(F.col("target.symbol"), F.col("target.relpath"), F.col("target.lineno")), F.lit(f"\t>={options.max_paths}")), 2, "at")
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    # the place in the whole, by a sort over ranges
    return every.orderBy("keyword", "step", "at", "place", "message").select("category", "message", F.monotonically_increasing_id().alias("seq"))


def run(spark: SparkSession, input_dir: str | Path, output_dir: str | Path, source_root: str | Path, options: Options = Options()) -> list[dict]:
    """Files of rows, manifests and ``diagnostics.txt`` in ``output_dir``; the manifests of what was done.

    Folders are ones that the driver and the executors share. With ``options.resume`` keywords that are
    done already stay as they are.
    """
    problems = [*folder_problems(input_dir, output_dir, source_root), *options.problems()]
    if problems:
        raise ValueError("; ".join(problems))
    todo, done = tsv.pending(spark, input_dir, output_dir, source_root, options)
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    tables, manifests = Tables(spark, "run"), []
    hits = tables.put(grep.read(spark, input_dir, list(todo), options.encoding_fallback, options.fast_encoding), "grep")
    result = analyse(spark, hits, source_root, options, tables)
    if todo:
        manifests = tsv.write(result.rows, output_dir, todo, options)
    left = spark.createDataFrame([("resume_skipped", k, (1 << 62) + n) for n, k in enumerate(done)], "category string, message string, seq long")
    text = diagnostics.render(result.notes.unionByName(left), options.diagnostics_detail_limit)
    (Path(output_dir) / "diagnostics.txt").write_text(text, "utf-8")
    tables.drop()
    return manifests
