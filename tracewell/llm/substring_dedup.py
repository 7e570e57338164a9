"""Removal of repeated word windows through a log-structured index of their fingerprints.

A window of ``WIDTH`` words is found by its anchor, the smallest hash of its runs of ``GRAM`` words
(the first of equals). Equal windows have equal anchors, and neighbouring windows mostly share one,
so the index holds about one fingerprint per 14 words. It is kept as sorted immutable runs: the
fingerprints of each new batch are merge-joined with the runs, which marks the anchors that occur
again, and written as a run of their own; many runs are compacted into one. Only for marked anchors
the windows themselves are compared, word by word.

The windows that share one anchor occurrence, a *stretch*, are first compared as a whole, so that a
passage with thousands of copies is one row from the first aggregation on; single windows are only
compared between different stretches of the same anchor.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U64, blocks, pair_hashes, signed, whole_windows, window_hashes, word_hashes, words
from ._stage import Stage

WIDTH, GRAM = 35, 8
#: Runs that an index has at most before they are compacted.
MOST_RUNS = 8
#: What share of the occurrences makes an anchor hot, and how many parts its texts are dealt over.
HOT_SHARE, HOT_PARTS = 1000, 64


def _stretches(hashes: np.ndarray, first: np.ndarray, width: int, gram: int):
    """Per stretch: anchor hash, hash of all its words, its first window, number of windows.

    Also the starts of all windows.
    """
    starts = whole_windows(first, width)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(U64), none.view(U64), none, none, none
    grams = window_hashes(hashes, gram)
    at, have, span = np.arange(len(grams)), 1, width - gram + 1
    while have < span:  # position of the first smallest gram among ``have`` from each one on
        step = min(have, span - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        have += step
    anchor = at[starts]
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate((begin, [len(starts)])))
    # its first and its last window overlap, and cover it
    full = window_hashes(hashes, width)
    whole = pair_hashes(pair_hashes(full[starts[begin]], full[starts[begin] + count - 1]), count.astype(U64))
    return grams[anchor[begin]], whole, starts[begin], count, starts


def _keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The text and a key of 128 bits of the row; rows alike in id and text have the same key."""
    i, t = F.col(doc_id).cast("string"), F.col(text).cast("string")
    return df.select(F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit("row"), t, i).alias("k2"), t.alias("t"))


class FingerprintIndex:
    """Sorted immutable runs of (anchor, n: occurrences, again: whether it was known by then).

    A run has ``buckets`` files, dealt by a hash of the anchor and sorted by it, so that a batch that is
    dealt and sorted alike is merge-joined with the runs without moving any of them. ``add`` marks what
    of a batch the runs have, or the batch has twice; ``repeated`` are the marks of all runs. Runs are
    compacted into one when there are ``MOST_RUNS``. Given a ``path`` below which an index was left,
    its runs are opened again.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, path: str | None = None, buckets: int | None = None):
        self.stage, self.width, self.gram = Stage(spark, "fingerprints"), width, gram
        if path:
            self.stage.root = path.rstrip("/")
        self.runs = sorted(self.stage.names())
        parts = [int(name.split("-")[2]) for name in self.runs]
        self.buckets = parts[0] if parts else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"run-{int(self.runs[-1].split('-')[1]) + 1 if self.runs else 0:06d}-{self.buckets}"
        table = f"tracewell_{uuid.uuid4().hex}"
        writer = df.select("anchor", "n", "again").write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor")
        writer.option("path", f"{self.stage.root}/{name}").option("compression", "zstd").saveAsTable(table)
        self.stage.spark.sql(f"DROP TABLE {table}")  # of the catalog only; the files stay
        return name

    def _read(self, name: str) -> DataFrame:
        """A run, known by its buckets."""
        spark, table = self.stage.spark, f"tracewell_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {table} (anchor BIGINT, n BIGINT, again BOOLEAN) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.stage.root}/{name}'")
        self.tables = [*getattr(self, "tables", []), table]
        return spark.table(table)

    def close(self, keep: bool = False) -> None:
        for table in getattr(self, "tables", []):
            self.stage.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []
        if not keep:
            self.stage.drop(*self.runs)

    def fingerprints(self, texts: DataFrame) -> DataFrame:
        width, gram = self.width, self.gram

        def run(batches):
            for _, data, off in blocks(batches, "t"):
                hashes, first = word_hashes(data, off)
                anchors, counts = np.unique(_stretches(hashes, first, width, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchors)), pa.array(counts)], ["anchor", "n"])

        dealt = texts.select("t").mapInArrow(run, "anchor long, n long")
        return dealt.groupBy("anchor").agg(F.sum("n").alias("n"))

    def add(self, texts: DataFrame) -> DataFrame:
        """Merge-join a batch with each run, write it as the next one, and return it."""
        batch = self.fingerprints(texts).repartition(self.buckets, "anchor")
        again = F.col("n") > 1
        for k, name in enumerate(self.runs):
            run = self._read(name).select("anchor", F.lit(True).alias(f"in{k}"))
            batch = batch.join(run.hint("merge"), "anchor", "left")
            again = again | F.coalesce(f"in{k}", F.lit(False))
        name = self._write(batch.select("anchor", "n", again.alias("again")))
        self.runs.append(name)
        out = self._read(name)
        if len(self.runs) >= MOST_RUNS:
            self.compact()
            out = self._read(self.runs[-1])
        return out

    def compact(self) -> None:
        """Merge all runs into one, which keeps every mark; their buckets need not be moved."""
        if len(self.runs) > 1:
            old, all_runs = list(self.runs), self._read(self.runs[0])
            for name in old[1:]:
                both = all_runs.join(self._read(name).select("anchor", F.col("n").alias("m"), F.col("again").alias("too")).hint("merge"), "anchor", "full")
                # a later run that has an earlier one's anchor is marked for it
                all_runs = both.select("anchor", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), (F.coalesce("again", F.lit(False)) | F.coalesce("too", F.lit(False))).alias("again"))
            self.runs = [*old, self._write(all_runs)]
            self.stage.drop(*old)
            self.runs = self.runs[len(old) :]

    def repeated(self) -> DataFrame:
        """(anchor, n) that a merge join found in an earlier run, or that a batch has twice; n: its marked occurrences."""
        marked = None
        for name in self.runs:
            run = self._read(name).where("again").select("anchor", "n")
            marked = run if marked is None else marked.unionAll(run)
        return marked.groupBy("anchor").agg(F.sum("n").alias("n"))


_STRETCH = "k1 long, k2 long, anchor long, whole long, start int, windows array<long>, body string"


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """All columns of ``df`` but the text, then ``kept_text``, ``n_words`` and ``n_removed``.

    A word goes if it is covered by a window of ``width`` words that also starts anywhere else, in
    the same text or another, as the table stands; the rest is joined by single spaces. A null or
    empty text, and one of fewer words than a window, loses nothing; for null, ``kept_text`` is
    empty. Rows that repeat, and several rows with one id or none, count as texts of their own: the
    windows of repeated rows are repeats. Columns that have one of the three names are replaced.
    The table is added to an index in ``batches`` batches, by a hash of the text; the marks of the index's
    merge joins say which anchors are looked at.
    """
    spark = df.sparkSession
    stage, index = Stage(spark, "windows"), FingerprintIndex(spark, width, gram)
    texts = _keyed(df, text, doc_id)
    for part in range(batches):
        index.add(texts.where(F.pmod("k2", F.lit(batches)) == part))
    anchors = stage.put(index.repeated(), "anchors")
    # an anchor of a thousandth of all marked occurrences, a thousand anchors at most, is dealt over parts
    total = anchors.agg(F.sum("n")).first()[0] or 0
    anchors = anchors.select("anchor", F.when(F.col("n") * HOT_SHARE >= total, HOT_PARTS).otherwise(1).alias("parts"))
    hot = F.broadcast(anchors.where("parts > 1"))
    anchors = anchors.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def occurrences(batches_):
        for batch, data, off in blocks(batches_, "t"):
            hashes, first = word_hashes(data, off)
            anchor, _, begin, _, _ = _stretches(hashes, first, width, gram)
            of = np.searchsorted(first, begin, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array(of)), batch.column("k2").take(pa.array(of)), pa.array(signed(anchor))], ["k1", "k2", "anchor"])

    # which texts have a repeated anchor, and which ones
    found = texts.mapInArrow(occurrences, "k1 long, k2 long, anchor long").join(hot, "anchor", "left")
    found = found.withColumn("part", F.coalesce(F.pmod(F.col("k1"), F.col("parts").cast("long")).cast("int"), F.lit(0))).join(anchors.hint("merge"), ["anchor", "part"])
    found = stage.put(found.groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors")), "found")

    def stretches(batches_):
        for batch, data, off in blocks(batches_, "t"):
            starts, ends, first = words(data, off)
            hashes, raw = word_hashes(data, off)[0], data.tobytes()
            anchor, whole, begin, count, window = _stretches(hashes, first, width, gram)
            of = np.searchsorted(first, begin, "right") - 1
            lists = batch.column("anchors").combine_chunks() if isinstance(batch.column("anchors"), pa.ChunkedArray) else batch.column("anchors")
            wanted = np.zeros(len(anchor), bool)
            values, ends_of = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(lists.value_lengths().to_pylist())])
            bounds = np.searchsorted(of, np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                mine = slice(bounds[i], bounds[i + 1])
                wanted[mine] = np.isin(signed(anchor[mine]), values[ends_of[i] : ends_of[i + 1]])
            keep = np.flatnonzero(wanted)
            full = signed(window_hashes(hashes, width)) if len(window) else np.zeros(0, np.int64)
            chosen = full[window[np.repeat(wanted, count)]] if len(window) else full
            offsets = pa.array(np.concatenate(([0], np.cumsum(count[keep]))), pa.int32())
            of = pa.array(of[keep])
            bodies = [b" ".join(raw[starts[a] : ends[b]].split()) for a, b in zip(begin[keep].tolist(), (begin[keep] + count[keep] + width - 2).tolist())]
            local = (begin[keep] - first[np.searchsorted(first, begin[keep], "right") - 1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(of), batch.column("k2").take(of), pa.array(signed(anchor[keep])), pa.array(signed(whole[keep])), pa.array(local), pa.ListArray.from_arrays(offsets, pa.array(chosen)), pa.array(bodies, pa.binary()).cast(pa.string())], ["k1", "k2", "anchor", "whole", "start", "windows", "body"])

    rows = texts.join(found.hint("merge"), ["k1", "k2"]).mapInArrow(stretches, _STRETCH)
    rows = stage.put(rows, "stretches")
    # stretches are alike if their words are; the hash beside the words tells their kinds apart from here on
    kinds = stage.put(rows.groupBy("anchor", "whole", "body").agg(F.count("*").alias("n"), F.first("windows").alias("windows")).withColumn("kind", F.xxhash64("body")), "kinds")
    # a window of a stretch that occurs once is repeated if another stretch of the anchor has it
    # anchors of one stretch only need no look at single windows, nor do those without a lone stretch
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    lone = kinds.join(stage.put(mixed, "mixed"), "anchor").select("anchor", "n", "whole", "kind", F.posexplode("windows").alias("at", "window"))
    lone = stage.put(lone, "lone")
    alike = stage.put(lone.groupBy("anchor", "window").agg(F.count("*").alias("m")).where("m > 1").select("anchor", "window"), "alike")
    # windows of one hash are compared word by word, in the stretches that they are in
    near = lone.join(alike, ["anchor", "window"]).groupBy("anchor", "whole", "kind").agg(F.collect_list(F.struct("at", "window")).alias("wanted"))
    near = near.join(kinds.select("anchor", "whole", "kind", "body", "n"), ["anchor", "whole", "kind"]).withColumn("words", F.split("body", " "))
    near = near.select("anchor", "whole", "kind", "n", F.explode("wanted").alias("w"), "words")
    near = stage.put(near.select("anchor", "whole", "kind", "n", "w.at", "w.window", F.array_join(F.slice("words", F.col("w.at") + 1, width), " ").alias("text")), "near")
    shared = near.groupBy("anchor", "window", "text").agg(F.count("*").alias("m")).where("m > 1").select("anchor", "window", "text")
    marks = near.where("n = 1").join(stage.put(shared, "shared"), ["anchor", "window", "text"]).groupBy("anchor", "whole", "kind").agg(F.sort_array(F.collect_list("at")).alias("at"))
    marks = kinds.where("n > 1").select("anchor", "whole", "kind", F.sequence(F.lit(0), F.size("windows") - 1).alias("at")).unionByName(marks)
    marks = stage.put(marks, "marks")
    starts = rows.select("k1", "k2", "anchor", "whole", F.xxhash64("body").alias("kind"), "start").distinct().join(marks, ["anchor", "whole", "kind"])
    # at most 28 positions for each of a text's stretches, which is the size of the text
    starts = starts.select("k1", "k2", F.transform("at", lambda a: a + F.col("start")).alias("at")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("at")).alias("repeats"))
    starts = stage.put(starts, "starts")
    stage.drop("anchors", "found", "stretches", "kinds", "mixed", "lone", "alike", "near", "shared", "marks")
    index.close()

    added = [("kept_text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())]
    kept = [f for f in df.schema.fields if f.name not in dict(added) and f.name != text]
    i, t = F.col(doc_id).cast("string"), F.col(text).cast("string")
    keyed = df.select(F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit("row"), t, i).alias("k2"), F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), t.alias("t"))
    joined = keyed.join(starts.hint("merge"), ["k1", "k2"], "left").select("row", "t", "repeats")

    def cut(batches_):
        for batch, data, off in blocks(batches_, "t"):
            begin, end, first = words(data, off)
            raw, texts_out, removed = data.tobytes(), [], []
            for k, repeats in enumerate(batch.column("repeats").to_pylist()):
                n = first[k + 1] - first[k]
                gone = np.zeros(n + 1, np.int64)
                if repeats:
                    at = np.array(repeats)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + first[k]
                    texts_out.append(b" ".join([raw[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist())]))
                    removed.append(n - len(stay))
                else:
                    texts_out.append(b" ".join(raw[off[k] : off[k + 1]].split()))
                    removed.append(0)
            out = pa.array(texts_out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), out, pa.array(np.diff(first)), pa.array(removed, pa.int64())], ["row", *dict(added)])

    schema = T.StructType([T.StructField("row", T.StructType(kept)), *(T.StructField(*a) for a in added)])
    return joined.mapInArrow(cut, schema).select(*[F.col("row").getField(f.name).alias(f.name) for f in kept], *dict(added))
