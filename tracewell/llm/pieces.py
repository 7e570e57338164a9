"""SentencePiece encoding by Viterbi over a trie of words, and decoding.

The vocabulary and its scores are those of an existing SentencePiece file; the encoding has the
largest sum of scores over all segmentations. Spaces are word marks, one is put before
the text, and pieces don't cross word marks or line breaks. The different marked words of a block are
sorted, which makes neighbours share prefixes, and traversed like the trie that they form, depth
first: the forward scores of the prefix shared with the word before are kept, only the rest is new.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import NUMBER_BYTES, blocks, ragged, span_numbers
from ._stage import small_batches

#: Bytes of text whose words are sorted together, and encoded words that a worker remembers.
SORTED_BYTES, REMEMBERED = 4 << 20, 200_000
#: How much less than the least score an unknown character has, as in the library.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces of a SentencePiece file, with a space for the word mark."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids = [0] * 256
        self.decoded: list[bytes] = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.decoded.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.decoded.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.decoded.append(text.encode())
                if text.rfind(" ") <= 0:
                    self.pieces[text] = (library.get_score(i), i)
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted words."""
        get, longest, unknown = self.pieces.get, self.longest, self.unknown
        best, back, ids, out, last = [0.0], [0], [-1], [], ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # an unknown character is spelled in bytes; of equal sums the longest last piece wins
                top, start, piece = -float("inf"), end - 1, -1
                for begin in range(max(0, end - longest), end):
                    found = get(word[begin:end])
                    if found is not None and best[begin] + found[0] > top:
                        top, start, piece = best[begin] + found[0], begin, found[1]
                if get(word[end - 1 : end]) is None and best[end - 1] + unknown > top:
                    top, start, piece = best[end - 1] + unknown, end - 1, -1
                best.append(top)
                back.append(start)
                ids.append(piece)
            path, at = [], len(word)
            while at:
                if ids[at] < 0:
                    path += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
                else:
                    path.append(ids[at])
                at = back[at]
            path.reverse()
            out.append(path)
            last = word
        return out


class Encoder:
    """Ids of blocks of texts; each different marked word is encoded once, as far as it is remembered."""

    def __init__(self, path: str):
        self.vocabulary, self.known = Vocabulary(path), {}

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one entry more)."""
        # a word mark before each text that isn't empty
        full = np.flatnonzero(np.diff(off) > 0)
        data = np.insert(data, off[full], 32)
        off = off + np.concatenate(([0], np.cumsum(np.diff(off) > 0)))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        # marked words begin at spaces, line breaks are for themselves
        new = (data == 32) | (data == 10)
        new[1:] |= data[:-1] == 10
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        unit, table, begin, size = self._different(data, starts, ends)
        many = size[unit]
        ids = table[ragged(begin[unit], many)]
        bounds = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(starts, off)]
        return ids, bounds

    def _different(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Which of the different words each one is; their ids in a row, where each begins and how many."""
        hashes, low, high = span_numbers(data, starts, ends)
        _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        # words of one hash are one only if their bytes are
        size, raw, of = ends - starts, data.tobytes(), first[unit]
        same = (low == low[of]) & (high == high[of]) & (size == size[of])
        for k in np.flatnonzero(size > NUMBER_BYTES).tolist():
            same[k] = raw[starts[k] : ends[k]] == raw[starts[of[k]] : ends[of[k]]]
        odd = np.flatnonzero(~same)
        unit[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        names = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        new = set(names).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(names)
        order = sorted(new)
        self.known.update(zip(order, (array("i", ids).tobytes() for ids in self.vocabulary.encode_sorted(order))))
        parts = [self.known[x] for x in names]
        many = np.array([len(x) // 4 for x in parts], np.int64)
        return unit, np.frombuffer(b"".join(parts), np.int32), np.cumsum(many) - many, many


class Decoder:
    """Texts of ids."""

    def __init__(self, vocabulary: Vocabulary):
        # one piece more stands for ids outside the vocabulary
        size = np.array([*map(len, vocabulary.decoded), 0], np.int64)
        self.size, self.begin, self.bytes = size, np.cumsum(size) - size, np.frombuffer(b"".join(vocabulary.decoded), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each of the ranges of ids, without its first word mark."""
        at = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[at]
        data = self.bytes[ragged(self.begin[at], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[bounds]
        starts = ends[:-1].copy()
        full = np.flatnonzero(np.diff(ends) > 0)
        starts[full] += data[starts[full]] == 32
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends[1:].tolist())], pa.string())


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """All columns of ``df``, then ``piece_ids``, and with ``decoded`` a column of the text that they give.

    A null or empty text has no ids; any other has those of the text with a word mark before it, so
    that decoding gives back every text, whatever its characters. Columns that have the names of new
    ones are replaced; that of the text itself can't be.
    """
    if text in ("piece_ids", decoded):
        raise ValueError(f"the column {text} would be replaced by its own result")
    small_batches(df.sparkSession)
    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in names]

    def run(batches):
        encoder = Encoder(path)
        decoder = Decoder(encoder.vocabulary)
        for batch, data, off in blocks(batches, text, SORTED_BYTES):
            ids, bounds = encoder(data, off)
            more = [decoder(ids, bounds)] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids, bounds), *more], [*batch.schema.names, *names])

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *added]))


def decode(df: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """All columns of ``df``, then the text of its ids without the first word mark.

    Null ids give null, no ids the empty text; ids outside the vocabulary and control pieces stand
    for nothing. A column that has the new one's name is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != into]

    def run(batches):
        decoder = Decoder(Vocabulary(path))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).cast(pa.list_(pa.int64()))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            texts = decoder(values, np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, into])

    schema = T.StructType([*kept, T.StructField(into, T.StringType())])
    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
