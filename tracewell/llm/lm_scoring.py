"""Marginal probability of a text over all its segmentations into the pieces of a vocabulary.

The vocabulary and the order of its scores are those of an existing tokenizer file. A piece's
probability is its count over the training texts, segmented by that tokenizer, plus a share of
``PRIOR`` counts that falls with the rank its score gives it, so no piece is impossible; bytes are
pieces, so no text is. A forward recursion in log space sums over all segmentations of a word. Pieces
don't cross words, so each distinct word is summed over once, for the whole corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, blocks
from ._stage import Stage

PRIOR = 32_000.0
#: Different words that a task holds before it hands their counts on.
HELD_WORDS = 300_000
#: Words, the most frequent ones up to a length, whose values every task has. The rest are joined.
SHARED_WORDS, SHARED_LENGTH = 1 << 18, 64
#: Bytes of text whose words a task holds at most.
HELD_BYTES = 64 << 20
#: Words in one piece of the recursion, and the most bytes of a padded table of them.
GROUP_WORDS, GROUP_BYTES = 4096, 1 << 18


class Pieces:
    """The tokenizer file's pieces as bytes, a leading space for its word mark."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        scores = np.array([self.library.get_score(i) for i in range(size)])
        self.bytes: list[bytes | None] = []
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                self.bytes.append(None)
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        rank = np.empty(size)
        rank[np.argsort(-scores, kind="stable")] = np.arange(size)
        self.prior = np.array([0.0 if b is None else 1 / (r + 10) for b, r in zip(self.bytes, rank)])
        self.prior *= PRIOR / self.prior.sum()


_FACTOR = U64(0x100000001B3)
_OFFSET = U64(0xCBF29CE484222325)


@dataclass
class Lattice:
    """A trie of the pieces by depth: hashes of all prefixes, sorted, and log probabilities (-inf: no piece)."""

    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, pieces: list[bytes | None], share: np.ndarray) -> Lattice:
        total: dict[bytes, float] = {}
        for piece, p in zip(pieces, share):
            # within a word a space only stands at its start
            if piece and p > 0 and piece.rfind(b" ") <= 0:
                total[piece] = total.get(piece, 0.0) + p
        levels = []
        for depth in range(1, max(map(len, total), default=0) + 1):
            prefixes = sorted({piece[:depth] for piece in total if len(piece) >= depth})
            keys = np.full(len(prefixes), _OFFSET)
            for column in np.frombuffer(b"".join(prefixes), np.uint8).reshape(-1, depth).T:
                keys = (keys ^ column) * _FACTOR
            logs = np.array([math.log(total[x]) if x in total else -math.inf for x in prefixes])
            order = np.argsort(keys)
            levels.append((keys[order], logs[order]))
        return cls(levels)

    def log_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each of the words, word mark included."""
        out = np.zeros(len(texts))
        size = np.array([len(t) + 1 for t in texts], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            n = min(GROUP_WORDS, len(order) - at)
            while n > 1 and n * size[order[at + n - 1]] > GROUP_BYTES:
                n //= 2
            chosen = order[at : at + n]
            out[chosen] = self._forward([b" " + texts[k] for k in chosen], size[chosen])
            at += n
        return out

    def edges(self, data: np.ndarray, end: np.ndarray):
        """(first byte, length, log probability) of all pieces in the bytes, up to the ``end`` of each byte's word."""
        begin, keys = np.arange(len(data)), np.full(len(data), _OFFSET)
        for length, (known, logs) in enumerate(self.levels, 1):
            inside = begin + length <= end[begin]
            begin = begin[inside]
            keys = (keys[inside] ^ data[begin + length - 1]) * _FACTOR
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            on = known[at] == keys
            begin, keys, log = begin[on], keys[on], logs[at[on]]
            piece = log > -np.inf
            yield begin[piece], length, log[piece]
            if not len(begin):
                return

    def _forward(self, texts: list[bytes], size: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        found = [(b, np.full(len(b), n), x) for b, n, x in self.edges(data, np.repeat(first + size, size))]
        begin, length, log = (np.concatenate([f[k] for f in found]) for k in range(3))
        of = np.repeat(np.arange(len(texts)), size)[begin]
        last = begin - first[of] + length
        order = np.lexsort((of, length, last))
        of, last, length, log = of[order], last[order], length[order], log[order]
        if len(texts) == 1:
            return np.array([self._forward_one(int(size[0]), last, length, log)])
        # pieces of one length that end at one place are in different words
        alpha = np.full((int(size[-1]) + 1, len(texts)), -np.inf)
        alpha[0] = 0.0
        cuts = np.flatnonzero(np.concatenate(([True], (last[1:] != last[:-1]) | (length[1:] != length[:-1])))) if len(last) else last
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(last)).tolist()):
            i, words_ = last[a], of[a:b]
            alpha[i, words_] = np.logaddexp(alpha[i, words_], alpha[i - length[a], words_] + log[a:b])
        return alpha[size, np.arange(len(texts))]

    @staticmethod
    def _forward_one(size: int, last: np.ndarray, length: np.ndarray, log: np.ndarray) -> float:
        """One long word, in time in proportion to its length."""
        alpha, at, terms = [0.0] + [-math.inf] * size, 0, []
        for i, n, x in zip(last.tolist(), length.tolist(), log.tolist()):
            if i != at:
                alpha[at] = _log_sum(terms) if at else 0.0
                at, terms = i, []
            terms.append(alpha[i - n] + x)
        alpha[at] = _log_sum(terms)
        return alpha[size]


def _log_sum(terms: list[float]) -> float:
    most = max(terms, default=-math.inf)
    return most + math.log(sum(math.exp(x - most) for x in terms)) if most > -math.inf else most


def _word_counts(df: DataFrame) -> DataFrame:
    """(word, c: occurrences in training rows) of all rows' words; words are lower-cased bytes."""

    def run(batches):
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush():
            names = [n for c in held.values() for n in c]
            counts = [n if train else 0 for train, c in held.items() for n in c.values()]
            for c in held.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

        taken = 0
        for batch, data, off in blocks(batches, "t"):
            raw = data.tobytes().lower()
            taken += len(raw)
            for train, a, b in zip(batch.column("train").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                held[train].update(raw[a:b].split())
            if taken > HELD_BYTES or sum(map(len, held.values())) > HELD_WORDS:
                yield flush()
                taken = 0
        yield flush()

    return df.select("train", "t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _piece_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each piece stands in the training words, as the tokenizer segments them."""

    def run(batches):
        library = None
        total = None
        for batch in batches:
            if library is None:
                import sentencepiece

                library = sentencepiece.SentencePieceProcessor(model_file=path)
                total = np.zeros(library.get_piece_size(), np.int64)
            names = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            n = np.array(batch.column("c").to_pylist(), np.int64)
            ids = library.encode(names, num_threads=1)
            lengths = np.array([len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
            total += np.bincount(flat, weights=np.repeat(n, lengths), minlength=len(total)).astype(np.int64)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    # a row for each piece of the vocabulary at most
    rows = counts.where("c > 0").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["piece"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        out[r["piece"]] = r["n"]
    return out


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have as many or more."""
    bins = counts.where("c > 0").groupBy(F.floor(F.log("c") * 16).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c"))
    least, total = None, 0
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    return least if least is not None else 1 << 62


def score(df: DataFrame, train, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a condition on ``df``; rows for which it isn't true are held out. Texts (null:
    empty) are words in lower case (A-Z) and one end, which counts as a token. ``base_score`` sums
    log10 of the add-one estimates of the tokens from the training rows, ``score`` is log10 of the
    product of the words' marginal probabilities and that of the end. Rows that repeat count as often
    as they stand there. Without training rows every token is unknown and pieces have their prior
    only. Other columns are not carried.
    """
    spark = df.sparkSession
    stage = Stage(spark, "lattice")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    counts = stage.put(_word_counts(rows), "counts")
    ends = rows.where("train").count()
    tokens, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, different = tokens + ends, different + (ends > 0)
    pieces = Pieces(path)
    seen = _piece_counts(counts, path)
    share = pieces.prior.copy()
    share[: len(seen)] += seen
    share[[b is None for b in pieces.bytes]] = 0
    whole = share.sum() + ends + 1
    end_log = math.log10((ends + 1) / whole)
    lattice = spark.sparkContext.broadcast(Lattice.of(pieces.bytes, share / whole))

    def values(batches):
        for batch in batches:
            logs = lattice.value.log_probabilities(batch.column("word").to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs)], ["word", "c", "lp"])

    table = stage.put(counts.select("word", "c").mapInArrow(values, "word binary, c long, lp double"), "words")
    stage.drop("counts")
    # at most SHARED_WORDS rows of bounded size
    some = table.where(F.length("word") <= SHARED_LENGTH)
    top = some.where(F.col("c") >= _frequent_from(some, SHARED_WORDS)).toArrow()
    known = spark.sparkContext.broadcast((top["word"].to_pylist(), np.log10(top["c"].to_numpy() + 1.0), top["lp"].to_numpy()))

    def look_up(batches):
        names, bases, logs = known.value
        place, none = {w: k for k, w in enumerate(names)}, len(names)
        bases, logs = np.append(bases, 0.0), np.append(logs, 0.0)
        number = TaskContext.get().partitionId() << 33
        for batch, data, off in blocks(batches, "t"):
            raw, sums, rest, bounds = data.tobytes().lower(), [], [], [0]
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                split = raw[a:b].split()
                at = np.array([place.get(w, none) for w in split], np.int64)
                sums.append((len(split) + 1, int((at < none).sum()), float(bases[at].sum()), float(logs[at].sum())))
                rest += [split[k] for k in np.flatnonzero(at == none).tolist()]
                bounds.append(len(rest))
            n = batch.num_rows
            columns = list(zip(*sums)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + n)), batch.column("doc_id"), pa.array([not x for x in batch.column("train").to_pylist()], pa.bool_()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rest, pa.binary()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "rest"],
            )
            number += n

    kind = df.schema[doc_id].dataType.simpleString()
    part = stage.put(rows.select("doc_id", "train", "t").mapInArrow(look_up, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lp double, rest array<binary>"), "rows")
    rest = part.select("row", F.explode("rest").alias("word")).join(table, "word")
    rest = rest.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("b"), F.sum("lp").alias("l"))
    done = part.drop("rest").join(stage.put(rest, "rest"), "row", "left")
    lower = math.log10(tokens + different + 1)
    none = F.lit(0.0)
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", none) + math.log10(ends + 1) - F.col("n_tokens") * lower).alias("base_score"),
        (F.col("lp") + F.coalesce("l", none) + end_log).alias("score"),
    )
