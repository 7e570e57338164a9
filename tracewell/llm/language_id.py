"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import LOWER, blocks
from ._stage import small_batches

#: Hash buckets of n-grams, and their lengths in characters.
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: About so many labelled rows of each language are learned from, chosen by a hash of their id.
FIT_ROWS = 4000
#: The evidence of a long text counts as that of so many n-grams, so that scores don't all become 1.
EVIDENCE = 64
UNKNOWN = "und"
_FACTORS = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with ASCII letters in lower case, and the first of each text (one entry more)."""
    data = LOWER[data]
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), begins[off]


def ngrams(points: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket at each character, and how many n-grams start in each text."""
    out, spread = [], [points * f for f in _FACTORS]
    for order in ORDERS:
        n = max(0, len(points) - order + 1)
        h = spread[0][:n].copy()
        for j in range(1, order):
            h ^= np.left_shift(spread[j][j : j + n], np.uint32(j)) + np.uint32(order)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        out.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1), np.maximum(0, np.diff(first) - order + 1)))
    return out


def _sums(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the values at the first ``counts`` characters of each text."""
    total = np.zeros((len(counts),) + values.shape[1:])
    full = np.flatnonzero(counts)
    if len(full):
        bounds = np.stack([first[full], first[full] + counts[full]], 1).ravel()
        padded = np.concatenate([values, np.zeros((1,) + values.shape[1:], values.dtype)])
        total[full] = np.add.reduceat(padded, bounds, axis=0, dtype=np.float64)[::2]
    return total


@dataclass
class LanguageModel:
    """``weights``: log probability by bucket (rows) and language; ``prior``: log share of each."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        points, first = _characters(data, off)
        scores, seen = np.zeros((len(off) - 1, len(self.languages))), np.zeros(len(off) - 1)
        for bucket, counts in ngrams(points, first):
            seen += counts
            for k in range(0, len(self.languages), 8):
                scores[:, k : k + 8] += _sums(self.weights[bucket, k : k + 8], first, counts)
        letters = self._letters(data, off)
        if not self.languages:
            return [UNKNOWN] * len(letters), np.zeros(len(letters))
        best = (scores + self.prior).argmax(1)
        scores = scores * np.minimum(1, EVIDENCE / np.maximum(seen, 1))[:, None] + self.prior
        scores = np.exp(scores - scores.max(1, keepdims=True))
        scores /= scores.sum(1, keepdims=True)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, scores[np.arange(len(best)), best], 0.0)

    @staticmethod
    def _letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each text has a letter."""
        low = LOWER[data]
        ascii_letters = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
        found = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
        for i in np.flatnonzero(~found):
            found[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
        return found


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from the rows whose text and language aren't null.

    Of each language about ``fit_rows`` rows take part (all, if fewer): those whose id hashes below
    a bound set from the language's row count. The sample, and so what comes back to the driver, is
    bounded by that and the number of languages.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    names = sorted(counts)
    share = F.coalesce(*[F.when(F.col("l") == name, F.lit(min(1.0, fit_rows / counts[name]))) for name in names])
    sample = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("language")), F.lit(1 << 20)) < share * (1 << 20)).repartition(8)
    index = {name: k for k, name in enumerate(names)}

    def count(batches):
        table = np.zeros((len(names), BUCKETS), np.int64)
        for batch, data, off in blocks(batches, "t"):
            points, first = _characters(data, off)
            label = np.array([index[x] for x in batch.column("l").to_pylist()])
            for bucket, n in ngrams(points, first):
                for k in np.unique(label):
                    inside = np.zeros(len(points) + 1, np.int64)
                    mine = (label == k) & (n > 0)
                    np.add.at(inside, first[:-1][mine], 1)
                    np.add.at(inside, first[:-1][mine] + n[mine], -1)
                    table[k] += np.bincount(bucket[np.cumsum(inside)[: len(bucket)] > 0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()])], ["table"])

    total = np.zeros((len(names), BUCKETS))
    for row in sample.mapInArrow(count, "table binary").toLocalIterator():
        total += np.frombuffer(row["table"], np.int64).reshape(total.shape)
    smooth = total + 0.5
    weights = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)
    rows_of = np.array([counts[x] for x in names], float)
    return LanguageModel(names, np.ascontiguousarray(weights), np.log(rows_of / rows_of.sum()))


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``df``, then ``lang_pred`` and ``lang_score``.

    ``lang_pred`` is the likeliest language by all n-grams; ``lang_score`` is its posterior with the
    evidence of a long text cut to that of ``EVIDENCE`` n-grams. A text that is null, empty or without letters
    is ``und`` with score 0, as is every text under a model that has learned no language. Columns
    that have those two names already are replaced.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "lang_score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches):
        for batch, data, off in blocks(batches, text):
            names, scores = shared.value.predict(data, off)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "lang_score"])

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
