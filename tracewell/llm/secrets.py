"""Secret scans: fixed patterns, and automata inferred from the credentials that those find."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import blocks
from ._stage import Stage, small_batches

# The base patterns, their least lengths and their order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "format")
_HEX_HINT = re.compile(rb"[0-9a-f]{24,}")

#: What may be a credential: long runs with a digit and a letter.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
#: So many different credentials of each kind, those with the smallest hashes, are learned from.
FIT_VALUES = 400
#: Confidence of the test whether two states differ; likelihood quantile that a candidate must reach.
ALPHA, ACCEPT_QUANTILE = 0.05, 0.05

_CLASS = np.frombuffer(bytes(range(256)), np.uint8).copy()
for _symbol, _members in ((b"0", b"0123456789"), (b"a", b"abcdef"), (b"g", b"ghijklmnopqrstuvwxyz"), (b"A", b"ABCDEF"), (b"G", b"GHIJKLMNOPQRSTUVWXYZ")):
    _CLASS[list(_members)] = _symbol[0]
_CLASSES = _CLASS.tobytes()


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(first byte, kind, past-the-end byte, credential) of each base match in a text's UTF-8."""
    found = []
    if b":" in text or b"=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a greedy run of 24 or more is the whole run, so shorter ones need not be matched to be dropped
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX_HINT.finditer(text)]
    return sorted(found)


def candidates(text: bytes, base: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Runs that may be credentials and touch no base span."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(48 <= c <= 57 for c in run) and any(c >= 65 for c in run.replace(b"_", b"")) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append(m.span())
    return out


class Automaton:
    """A deterministic probabilistic automaton over character classes."""

    def __init__(self, strings: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.flow: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s.translate(_CLASSES):
                self.flow[at][c] = self.flow[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.flow.append({})
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self.symbols = sorted({c for f in self.flow for c in f})

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.flow[q].values())

    def _alike(self, p: int, q: int, bound: float) -> bool:
        """Whether no future of the two states differs by more than chance (Hoeffding's bound)."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            m, n = self._total(p), self._total(q)
            if not m or not n:
                continue
            most = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[p] / m - self.ends[q] / n) > most:
                return False
            for c in self.flow[p].keys() | self.flow[q].keys():
                if abs(self.flow[p].get(c, 0) / m - self.flow[q].get(c, 0) / n) > most:
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p, state by state."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.flow[q].items():
                self.flow[p][c] = self.flow[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self, bound: float) -> None:
        """States are settled from the root on; each next one is merged into a settled state, or settles."""
        red = [0]
        while True:
            settled = set(red)
            edge = next(((p, c) for p in red for c in sorted(self.next[p]) if self.next[p][c] not in settled), None)
            if edge is None:
                return
            p, c = edge
            q = self.next[p][c]
            same = next((r for r in red if self._alike(r, q, bound)), None)
            if same is None:
                red.append(q)
            else:
                self.next[p][c] = same
                self._fold(same, q)

    def score(self, string: bytes) -> float:
        """Mean log2 probability of the symbols, the end included, with add-one smoothing of what a state has seen.

        A string that leaves the automaton has none.
        """
        at, total, size = 0, 0.0, len(self.symbols) + 1
        for c in string.translate(_CLASSES):
            if c not in self.next[at]:
                return -math.inf
            total += math.log2((self.flow[at].get(c, 0) + 1) / (self._total(at) + size))
            at = self.next[at][c]
        total += math.log2((self.ends[at] + 1) / (self._total(at) + size))
        return total / (len(string) + 1)


@dataclass
class SecretModel:
    """Automata of the kinds with enough credentials, each with the least score it accepts."""

    automata: list[tuple[Automaton, float]]

    def accepts(self, run: bytes) -> bool:
        return any(a.score(run) >= least for a, least in self.automata)


def learn(credentials: dict[int, list[bytes]], alpha: float = ALPHA, quantile: float = ACCEPT_QUANTILE) -> SecretModel:
    """An automaton for each kind with 20 credentials or more; a fifth of them sets what it accepts."""
    automata = []
    for _, values in sorted(credentials.items()):
        if len(values) >= 20:
            held = values[::5]
            a = Automaton([v for i, v in enumerate(values) if i % 5], alpha)
            scores = sorted(s for s in map(a.score, held) if s > -math.inf)
            if scores:
                automata.append((a, scores[int(quantile * len(scores))]))
    return SecretModel(automata)


def fit(df: DataFrame, text: str = "text", fit_values: int = FIT_VALUES) -> SecretModel:
    """Learn from base matches of all rows: ``fit_values`` different credentials of each kind.

    The credentials with the smallest hashes are taken, so that at most three times ``fit_values``
    strings (of 512 bytes at most; longer ones are left out of learning) come to the driver.
    """

    def matches(batches):
        for batch, data, off in blocks(batches, "t"):
            raw = data.tobytes()
            rows = {(k, v) for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for _, k, _, v in base_spans(raw[a:b]) if len(v) <= 512}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.decode() for _, v in rows], pa.string())], ["kind", "value"])

    stage = Stage(df.sparkSession, "secrets")
    found = stage.put(df.select(F.col(text).cast("string").alias("t")).mapInArrow(matches, "kind int, value string").distinct(), "credentials")
    credentials = defaultdict(list)
    for kind in range(3):
        for row in found.where(F.col("kind") == kind).orderBy(F.md5("value"), "value").limit(fit_values).collect():
            credentials[kind].append(row["value"].encode())
    stage.drop("credentials")
    return learn(credentials)


def spans_of(text: bytes, model: SecretModel) -> list[tuple[int, int, int]]:
    """(first byte, kind, past-the-end byte) of the base matches and the accepted candidates of a text."""
    base = base_spans(text)
    return sorted([(x, k, y) for x, k, y, _ in base] + [(x, 3, y) for x, y in candidates(text, base) if model.accepts(text[x:y])])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(df: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """All columns of ``df``, then ``secrets``: kind, start and end (code points, end exclusive).

    Spans stand by start, then by kind in the order of ``KINDS``. Those of kind ``format`` are
    candidates that a base pattern does not touch and an automaton accepts. A null or empty text has
    none. A column named ``secrets`` is replaced.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name != "secrets"]
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, data, off in blocks(batches, text):
            raw, rows = data.tobytes(), []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                one = raw[a:b]
                spans = spans_of(one, shared.value)
                if spans and not one.isascii():
                    point = np.concatenate(([0], np.cumsum((np.frombuffer(one, np.uint8) & 0xC0) != 0x80)))
                    spans = [(int(point[x]), k, int(point[y])) for x, k, y in spans]
                rows.append([{"kind": KINDS[k], "start": x, "end": y} for x, k, y in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind_type)], [*batch.schema.names, "secrets"])

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("secrets", SPAN)]))


MASK = "[SECRET]"


def mask(df: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """``df`` with each span of ``scan`` replaced by ``MASK``; spans that overlap become one mask.

    Null and empty texts stay as they are, and so do all other columns, one named ``secrets`` too.
    """
    small_batches(df.sparkSession)
    schema = df.schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, off in blocks(batches, text):
            raw, out = data.tobytes(), []
            for valid, a, b in zip(batch.column(text).is_valid().to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                one, parts, at = raw[a:b], [], 0
                for x, y in _joined([(x, y) for x, _, y in spans_of(one, shared.value)]):
                    parts += [one[at:x], MASK.encode()]
                    at = y
                out.append(b"".join([*parts, one[at:]]) if valid else None)
            masked = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([masked if n == text else batch.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(run, schema)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
