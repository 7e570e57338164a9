"""Packing of tokenized documents into training sequences with a bounded number of open windows."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import blocks
from ._stage import Stage

SEQUENCE, END_ID, OPEN_WINDOWS = 2048, 1, 16
#: Encoded parts of texts that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 200_000
#: Partitions whose last, partly filled windows are merged together in one task.
MERGED_PARTITIONS = 1024
#: UTF-8 lead bytes of code points from U+0240 on; texts with one of these go to the library whole.
FAR_LEAD = 0xC9


def _split_pattern() -> re.Pattern:
    """How the tokenizer's file splits a text, for code points below U+0240 only.

    The library's ``\\s``, ``\\p{L}`` and ``\\p{N}`` are spelled out, since those of ``re`` differ.
    """
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x240) if unicodedata.category(chr(c))[0] == kind)
    letter, number, space = of("L"), of("N"), "\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by a byte-level BPE file of ``tokenizers``.

    The file's own splitting of a text is done here, and each different part is encoded once, by the
    file's vocabulary, in which lower ids merge first. Texts beyond the splitter's characters go to
    the library whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None
        symbols = _byte_symbols()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file.get("added_tokens", ())}
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in special}
        self.part = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = _split_pattern().findall
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if not text.isascii() and max(raw) >= FAR_LEAD:
            return self.whole(text)
        parts, known = self.split(text), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for part in set(parts).difference(known):
                known[part] = array("I", self.part(part)).tobytes()
            return b"".join(map(known.__getitem__, parts))


@dataclass
class _Window:
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)  # (doc_id, start, ids as bytes, doc_tokens)


class Packer:
    """Keeps at most ``slots`` open windows; ``add`` and ``end`` return the windows that close.

    A document first gives off full windows of its own. What is left goes to the open window that it
    fits best. If none fits, the fullest is filled up with the document's first ids and closed, and
    the rest starts a window of its own, so that only the last windows of a partition need padding.
    """

    def __init__(self, size: int = SEQUENCE, slots: int = OPEN_WINDOWS):
        self.size, self.slots, self.open = size, slots, []

    def add(self, doc_id, ids: bytes) -> list[_Window]:
        total, at, closed = len(ids) // 4, 0, []
        while total - at >= self.size:
            closed.append(_Window(self.size, [(doc_id, at, ids[4 * at : 4 * (at + self.size)], total)]))
            at += self.size
        if at < total:
            fits = [w for w in self.open if w.used + total - at <= self.size]
            if fits:
                best = max(fits, key=lambda w: w.used)
            else:
                if len(self.open) == self.slots:
                    best = max(self.open, key=lambda w: w.used)
                    at += self._put(best, doc_id, at, ids[4 * at :], total)
                    self.open.remove(best)
                    closed.append(best)
                best = _Window()
                self.open.append(best)
            self._put(best, doc_id, at, ids[4 * at :], total)
            if best.used == self.size:
                self.open.remove(best)
                closed.append(best)
        return closed

    def _put(self, window: _Window, doc_id, at: int, ids: bytes, total: int) -> int:
        n = min(self.size - window.used, len(ids) // 4)
        window.pieces.append((doc_id, at, ids[: 4 * n], total))
        window.used += n
        return n

    def end(self) -> tuple[list[_Window], list[_Window]]:
        """The windows that are full once the emptiest are dealt out to the fullest, and the last one."""
        full, self.open = [], sorted(self.open, key=lambda w: -w.used)
        while len(self.open) > 1:
            target, source = self.open[0], self.open[-1]
            doc_id, at, ids, total = source.pieces.pop()
            source.used -= len(ids) // 4
            n = self._put(target, doc_id, at, ids, total)
            if 4 * n < len(ids):
                source.pieces.append((doc_id, at + n, ids[4 * n :], total))
                source.used += len(ids) // 4 - n
            if target.used == self.size:
                full.append(self.open.pop(0))
            if not source.used:
                self.open.remove(source)
        last, self.open = self.open, []
        return full, last


PIECE = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("window", T.LongType()), ("used", T.LongType()), ("offset", T.LongType()), ("open", T.BooleanType()))])


def _rows(windows: list[tuple[int, _Window, bool]], ids_too: bool) -> pa.RecordBatch:
    out = []
    for number, w, is_open in windows:
        at = 0
        for doc_id, start, ids, total in w.pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, ids if ids_too else None, zlib.crc32(ids), total, number, w.used, at, is_open))
            at += n
    columns = list(zip(*out)) or [()] * len(PIECE)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], PIECE.names)


def pack_partitions(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", ids_too: bool = True) -> DataFrame:
    """Each partition packed for itself: a row per piece, ``open`` for its last window only.

    ``window`` is unique over all partitions. With ``ids_too`` each piece carries its ids
    (little-endian unsigned 32-bit), else only their checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        sys.setswitchinterval(0.05)
        encode, packer, ready = Encoder(tokenizer), Packer(), []
        number, tail, pending = TaskContext.get().partitionId() << 32, np.array([END_ID], "<u4").tobytes(), 0
        for batch, data, off in blocks(batches, "t"):
            raw = data.tobytes()
            for doc, a, b in zip(batch.column("i").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                for w in packer.add(doc, encode(raw[a:b]) + tail):
                    ready.append((number, w, False))
                    pending += len(w.pieces)
                    number += 1
                if pending > 8000:
                    yield _rows(ready, ids_too)
                    ready, pending = [], 0
        full, last = packer.end()
        for w, is_open in [*((w, False) for w in full), *((w, True) for w in last)]:
            ready.append((number, w, is_open))
            number += 1
        yield _rows(ready, ids_too)

    return df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(run, PIECE)


def merge_leftovers(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``sequence_id`` and the offset there for all pieces, with the open windows merged best-fit.

    Each partition leaves one open window at most. Those of ``MERGED_PARTITIONS`` partitions, whose
    sizes alone go to one task, are joined whole, the largest first. ``pieces`` is read twice, so it
    should be a written table.
    """
    names = [c for c in pieces.columns if c not in ("window", "used", "offset", "open")]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bins: list[list[int]] = []
        out = []
        for window, used in sorted(zip(rows["window"], rows["used"]), key=lambda x: (-x[1], x[0])):
            fits = [b for b in bins if b[1] + used <= size]
            if fits:
                best = max(fits, key=lambda b: b[1])
            else:
                bins.append(best := [window, 0])
            out.append((window, best[0], best[1]))
            best[1] += used
        return pd.DataFrame(out, columns=["window", "sequence_id", "base"])

    left = pieces.where("open")
    sums = left.groupBy("window").agg(F.max("used").alias("used")).withColumn("many", F.shiftright("window", 32) / MERGED_PARTITIONS)
    moved = sums.withColumn("many", F.col("many").cast("long")).groupBy("many").applyInPandas(merge, "window long, sequence_id long, base long")
    done = pieces.where("not open").select(*names, F.col("window").alias("sequence_id"), "offset")
    rest = left.join(moved, "window").select(*names, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return done.unionByName(rest)


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", ids_too: bool = True) -> DataFrame:
    """Pack all rows into sequences of at most ``SEQUENCE`` ids; one row per piece of a document.

    A document's ids are those of its text, without special tokens, and ``END_ID``. Null and empty
    texts have that one id only. Rows that repeat, and rows with a null ``doc_id``, are documents of
    their own. An empty table has no pieces. Other columns are not carried. Columns: doc_id, start,
    length, ids (null without ``ids_too``), ids_crc32, doc_tokens, sequence_id, offset.
    """
    stage = Stage(df.sparkSession, "packing")
    return merge_leftovers(stage.put(pack_partitions(df, tokenizer, text, doc_id, ids_too), "pieces"))
