"""Quality rules: hashed word and character n-gram logistic regression with calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U64, blocks, mix, owners, whole_windows, window_hashes, word_hashes, words
from ._stage import small_batches

#: Buckets of each of the kinds of features: words, pairs of words, runs of three bytes.
BUCKETS = 1 << 11
KINDS = 3
#: At most about so many labelled rows of either class are learned from, chosen by a hash of the id.
FIT_ROWS = 1500
#: Fixed bounds of the verdict.
KEEP_FROM, MIN_WORDS, MAX_REPEATED_PERCENT = 0.5, 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SHIFT = U64(64 - BUCKETS.bit_length() + 1)


def _features(data: np.ndarray, off: np.ndarray, starts: np.ndarray, hashes: np.ndarray, first: np.ndarray):
    """For each kind: buckets, and where each text's begin (one entry more)."""
    n = len(hashes)
    pairs = whole_windows(first, 2)
    yield (hashes * U64(0x9E3779B97F4A7C15)) >> _SHIFT, first
    yield (window_hashes(hashes, 2)[pairs] if n > 1 else hashes[:0]) >> _SHIFT, np.searchsorted(pairs, first)
    runs = np.flatnonzero(np.arange(max(0, len(data) - 2)) + 3 <= np.repeat(off[1:], np.diff(off))[: max(0, len(data) - 2)])
    value = data[:-2].astype(U64) << U64(16) | data[1:-1].astype(U64) << U64(8) | data[2:] if len(data) > 2 else np.zeros(0, U64)
    yield (value[runs] * U64(0xD1B54A32D192ED03)) >> _SHIFT, np.searchsorted(runs, off)


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))


def _hashed(data: np.ndarray, off: np.ndarray):
    starts, ends, first = words(data, off)
    return starts, ends, first, word_hashes(data, off)[0]


@dataclass
class QualityModel:
    """Weights by kind and bucket, and Platt's scale and shift of the linear score."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, data: np.ndarray, off: np.ndarray, hashed=None) -> np.ndarray:
        starts, _, first, hashes = hashed or _hashed(data, off)
        score = np.full(len(off) - 1, self.bias)
        for k, (bucket, begin) in enumerate(_features(data, off, starts, hashes, first)):
            score += _means(self.weights[k][bucket], begin)
        return 1 / (1 + np.exp(-np.clip(self.scale * score + self.shift, -50, 50)))


def _learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam on the whole of x."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y) * weight
        g = np.append(x.T @ error.astype(np.float32) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return w, float(b)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """Learn from labelled rows, about ``fit_rows`` of either class (all, if fewer).

    Rows with a null id, label or text take no part; of labels only 0 and 1 count. Rows that repeat
    an id count as often as they stand there. A fifth of the sample, chosen by a hash, only serves
    to calibrate, weighted so that the classes have their shares of all labelled rows. Without rows of both classes there is no model (None).
    """
    small_batches(df.sparkSession)
    marks = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    at = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("quality")), F.lit(1 << 20))
    share = F.when(F.col("y") == 0, F.lit(min(1.0, fit_rows / counts[0]))).otherwise(F.lit(min(1.0, fit_rows / counts[1])))
    # about 2 * fit_rows rows of two numbers, whatever the tables hold
    marks = F.broadcast(marks.where(at < share * (1 << 20)))
    sample = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t is not null").join(marks, "i").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(5)))

    def extract(batches):
        for batch, data, off in blocks(batches, "t"):
            starts, _, first, hashes = _hashed(data, off)
            rows = np.zeros((batch.num_rows, KINDS, BUCKETS), np.float32)
            for k, (bucket, begin) in enumerate(_features(data, off, starts, hashes, first)):
                for i in range(batch.num_rows):
                    if begin[i + 1] > begin[i]:
                        rows[i, k] = np.bincount(bucket[begin[i] : begin[i + 1]], minlength=BUCKETS) / (begin[i + 1] - begin[i])
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in rows]), batch.column("y"), batch.column("part")], ["x", "y", "part"])

    rows = sample.repartition(8).select("i", "t", "y", "part").mapInArrow(extract, "x binary, y int, part long").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["part"], r["y"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    y, held = np.array([r["y"] for r in rows], np.float32), np.array([r["part"] == 0 for r in rows])
    del rows
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    share = {k: max(1, (y[~held] == k).sum()) for k in (0, 1)}
    balance = np.where(y == 1, 0.5 / share[1], 0.5 / share[0])
    scale = np.sqrt(np.maximum((x[~held] ** 2).mean(0), 1e-10))
    w, b = _learn(x[~held] / scale, y[~held], balance[~held], 250, 0.02, 1e-4)
    w = w / scale
    use = held if held.any() else ~held
    z = x[use] @ w + b
    middle, spread = float(z.mean()), float(z.std()) or 1.0
    stands_for = np.where(y[use] == 1, counts[1] / max(1, (y[use] == 1).sum()), counts[0] / max(1, (y[use] == 0).sum()))
    (a,), c = _learn(((z - middle) / spread)[:, None].astype(np.float32), y[use], stands_for / stands_for.sum(), 500, 0.05, 1e-4)
    return QualityModel(w.reshape(KINDS, BUCKETS), b, float(a) / spread, float(c) - float(a) * middle / spread)


def _repeated(hashes: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """How many words of each text lie in a window of ``width`` words that the text has twice."""
    starts, of = whole_windows(first, width), owners(first)
    if not len(starts):
        return np.zeros(len(first) - 1, np.int64)
    key = mix(window_hashes(hashes, width)[starts] ^ of[starts].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, starts[twice], 1)
    np.add.at(covered, starts[twice] + width, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
    return total[first[1:]] - total[first[:-1]]


def _line_repeats(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return again


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(data: np.ndarray, off: np.ndarray, hashed) -> dict[str, np.ndarray]:
    starts, ends, first, hashes = hashed
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    raw = data.tobytes()
    lines = [_line_repeats(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return dict(zip(FIELDS, (np.diff(first), chars[first[1:]] - chars[first[:-1]], symbols[off[1:]] - symbols[off[:-1]], np.array(lines, np.int64), _repeated(hashes, first))))


def score(df: DataFrame, model: QualityModel | None, text: str = "text") -> DataFrame:
    """All columns of ``df``, then the measures, ``quality_score``, ``base_failed`` and ``kept``.

    A null text counts as empty: no words, hence ``base_failed``. Without a model the score is null
    and only the base decides. Columns that have one of those names already are replaced.
    """
    small_batches(df.sparkSession)
    added = [*((f, T.LongType()) for f in FIELDS), ("quality_score", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    kept = [f for f in df.schema.fields if f.name not in dict(added)]
    schema = T.StructType([*kept, *(T.StructField(*a) for a in added)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, off in blocks(batches, text):
            hashed = _hashed(data, off)
            m = measure(data, off, hashed)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
            p = shared.value.probability(data, off, hashed) if shared.value else None
            good = ~failed & (p >= KEEP_FROM) if p is not None else ~failed
            out = [*(pa.array(m[f], pa.int64()) for f in FIELDS), pa.array(p, pa.float64()) if p is not None else pa.nulls(len(failed), pa.float64()), pa.array(failed), pa.array(good)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *dict(added)])

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
