"""Approximate nearest neighbours by inner product, with a hierarchical k-means tree.

Vectors get one more component that gives all of them the largest norm of the table, so the largest
inner product with a query is also the least distance, and k-means cells are sound for vectors of any
norm. The tree is fitted on a bounded sample and indexes every row. A query goes down best bin first:
a priority queue holds the open nodes by their centre's inner product with the query, and leaves are
visited in the order in which they leave the queue. How many leaves are visited is widened until a
sample of queries, searched exhaustively, finds ``RECALL`` of its true neighbours there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import Stage

#: Rows that the tree is fitted on at least and at most, its branching, and the rows a leaf should have.
FIT_ROWS, MOST_FIT_ROWS, BRANCHES, LEAF_ROWS = 16_384, 262_144, 16, 256
#: Queries that calibrate the visits, and the recall they must reach; above what is asked for.
CALIBRATION_QUERIES, RECALL = 200, 0.95
#: Rows and queries that meet in one group, and queries scored at once.
GROUP_ROWS, GROUP_QUERIES, STEP = 4096, 4096, 128


@dataclass
class Tree:
    """Nodes with centres; a node without children is a leaf, numbered in tree order."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int] = field(default_factory=list)

    def order(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        near = self.centres @ query
        heap, out = [(-near[c], c) for c in self.children[0]] or [(0.0, 0)], []
        heapq.heapify(heap)
        while heap and len(out) < most:
            _, at = heapq.heappop(heap)
            if self.children[at]:
                for c in self.children[at]:
                    heapq.heappush(heap, (-near[c], c))
            else:
                out.append(self.leaf[at])
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root down to the closest child."""
        at = np.zeros(len(x), np.int64)
        out = np.full(len(x), self.leaf[0], np.int64)
        moving = np.arange(len(x)) if self.children[0] else np.zeros(0, np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                at[rows] = np.array(self.children[node])[_closest(x[rows], self.centres[self.children[node]])]
            done = np.array([not self.children[n] for n in at[moving]])
            out[moving[done]] = [self.leaf[n] for n in at[moving[done]]]
            moving = moving[~done]
        return out


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = _closest(x, centres)
        for c in range(k):
            if (of == c).any():
                centres[c] = x[of == c].mean(0)
    return centres


def grow(x: np.ndarray, leaves: int, seed: int = 0) -> Tree:
    """Hierarchical k-means of the rows of x with about ``leaves`` leaves."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, x.shape[1])), [[]])
    centres, todo = [np.zeros(x.shape[1])], [(0, np.arange(len(x)), leaves)]
    while todo:
        at, rows, want = todo.pop(0)
        k = min(BRANCHES, want, len(np.unique(x[rows], axis=0))) if want > 1 and len(rows) > 1 else 1
        if k < 2:
            continue
        found = _k_means(x[rows], k, rng)
        of = _closest(x[rows], found)
        for c in range(k):
            mine = rows[of == c]
            if len(mine):
                centres.append(found[c])
                tree.children.append([])
                tree.children[at].append(len(centres) - 1)
                todo.append((len(centres) - 1, mine, round(want * len(mine) / len(rows))))
    tree.centres = np.array(centres)
    tree.leaf, number, stack = [-1] * len(centres), 0, [0]
    while stack:
        at = stack.pop()
        if tree.children[at]:
            stack += tree.children[at][::-1]
        else:
            tree.leaf[at] = number
            number += 1
    return tree


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that take part, in double precision, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == size)
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    x = flat[begin[good][:, None] + np.arange(size)] if len(good) else np.zeros((0, size))
    sound = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[sound], good[sound]


def _raised(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))[:, None]], 1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores above -inf, ties to smaller ids."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    near = near[scores[near] > -np.inf]
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search(df: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found rows of each query: query_id, rank, vec_id, score.

    ``queries`` is a condition on ``df``; every row but those with the query's id is a candidate.
    Score is the inner product of the vectors as they stand, in double precision; ties go to the
    smaller id. Vectors that are null, zero, of another length than the most common one, or hold a
    null or a number that isn't finite take no part, nor do rows without id. Of several queries with
    one id, one counts. With fewer than ``k`` candidates in the table all are returned.
    """
    spark = df.sparkSession
    stage = Stage(spark, "nearest")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where("id is not null and v is not null")
    sizes = rows.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("s")).limit(1).collect()
    size = sizes[0]["s"] if sizes else 0
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where((F.size("v") == size) & F.coalesce(sound, F.lit(False)))
    total, asked, norm = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not total:
        return df.select(F.col(vec_id).cast("long").alias("query_id"), F.lit(1).alias("rank"), F.col(vec_id).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).where("false")

    # the tree, from a sample of bounded size
    mark = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, n / total) * (1 << 30))
    # about 16 sampled rows for each of sqrt(total) leaves, so that leaves grow no faster than their number
    fit_rows = min(MOST_FIT_ROWS, max(FIT_ROWS, int(16 * total**0.5)))
    sample, _ = _matrix(rows.where(mark("fit", fit_rows)).select("v").toArrow().column("v"), size)
    if not len(sample):
        sample, _ = _matrix(rows.orderBy("id").limit(1).select("v").toArrow().column("v"), size)
    tree = spark.sparkContext.broadcast(grow(_raised(sample, norm), min(max(1, total // LEAF_ROWS), max(1, len(sample) // 8))))

    def place(batches):
        for batch in batches:
            x, which = _matrix(batch.column("v"), size)
            leaf = tree.value.assign(_raised(x, norm)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which)), batch.column("v").take(pa.array(which)), batch.column("q").take(pa.array(which)), pa.array(leaf, pa.int32())], ["id", "v", "q", "leaf"])

    placed = stage.put(rows.mapInArrow(place, "id long, v array<double>, q boolean, leaf int"), "placed")
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf

    # visits: how deep in the order of leaves the true neighbours of sampled queries lie
    asked_rows = placed.where("q").dropDuplicates(["id"])
    some = asked_rows.where(F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(1 << 30)) < int(min(1.0, CALIBRATION_QUERIES / max(1, asked)) * (1 << 30)))
    some = some.select("id", "v").toArrow().sort_by("id")
    probe, probe_ids = _matrix(some.column("v"), size)[0], some.column("id").to_numpy()
    visits = _calibrate(placed, probe, probe_ids, tree, size, k) if len(probe) else len(counts)

    # leaves go together in shards of about GROUP_ROWS rows; a larger leaf is a shard of several blocks
    shard_of, blocks_of, filled = {}, [], 0
    for leaf in sorted(counts):
        if not blocks_of or filled + counts[leaf] > GROUP_ROWS:
            blocks_of.append(1)
            filled = 0
        shard_of[leaf], filled = len(blocks_of) - 1, filled + counts[leaf]
        blocks_of[-1] = max(blocks_of[-1], -(-filled // GROUP_ROWS))
    shards, block_counts = spark.sparkContext.broadcast(shard_of), list(blocks_of)

    def visit(batches):
        for batch in batches:
            x, which = _matrix(batch.column("v"), size)
            at, shard, leaves = [], [], []
            for i, q in enumerate(x):
                by: dict[int, list[int]] = {}
                for leaf in tree.value.order(np.append(q, 0.0), visits):
                    if leaf in shards.value:
                        by.setdefault(shards.value[leaf], []).append(leaf)
                for s, found in sorted(by.items()):
                    at.append(which[i])
                    shard.append(s)
                    leaves.append(found)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["id", "v", "shard", "leaves"])

    visited = stage.put(asked_rows.select("id", "v").mapInArrow(visit, "id long, v array<double>, shard int, leaves array<int>"), "visited")
    asked_of = {r["shard"]: r["n"] for r in visited.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    parts = [-(-asked_of.get(s, 0) // GROUP_QUERIES) for s in range(len(block_counts))]
    table = lambda values, by: F.get(F.array(*[F.lit(int(v)) for v in values]), by)
    leaf_shard = table([shard_of.get(leaf, 0) for leaf in range(max(counts) + 1)], F.col("leaf"))
    salt = lambda by, n: F.pmod(F.xxhash64("id", F.lit(by)), n.cast("long")).cast("int")
    # each block of a shard's rows meets each part of the queries that visit the shard
    left = placed.select("id", "v", "leaf", leaf_shard.alias("shard"))
    left = left.withColumn("block", salt("block", table(block_counts, F.col("shard")))).withColumn("parts", table(parts, F.col("shard"))).where("parts > 0")
    left = left.select("id", "v", "leaf", "shard", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = visited.withColumn("part", salt("part", table([max(1, p) for p in parts], F.col("shard"))))
    right = right.select("id", "v", "leaves", "shard", F.explode(F.sequence(F.lit(0), table(block_counts, F.col("shard")) - 1)).alias("block"), "part")

    k_ = k

    def meet(rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows_.num_rows and asked_.num_rows:
            rows_ = rows_.sort_by("leaf")
            (x, _), (q, _) = _matrix(rows_.column("v"), size), _matrix(asked_.column("v"), size)
            ids, asked_ids, leaf = rows_.column("id").to_numpy(), asked_.column("id").to_numpy(), rows_.column("leaf").to_numpy()
            # the queries of each leaf meet the rows of that leaf only
            lists = asked_.column("leaves").combine_chunks()
            of = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            wanted = lists.flatten().to_numpy()
            for k in np.unique(wanted):
                a, b = np.searchsorted(leaf, (k, k + 1))
                if a < b:
                    mine = of[wanted == k]
                    for first in range(0, len(mine), STEP):
                        some = mine[first : first + STEP]
                        scores = q[some] @ x[a:b].T
                        scores[asked_ids[some][:, None] == ids[a:b]] = -np.inf
                        for i, s in zip(some, scores):
                            best = _top(s, ids[a:b], k_)
                            out.append((np.full(len(best), i), ids[a:b][best], s[best]))
            which, ids, scores = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
            order = np.lexsort((ids, -scores, which))
            rank = np.arange(len(order)) - np.searchsorted(which[order], which[order])
            order = order[rank < k_]
            out = [(asked_ids[which[order]], ids[order], scores[order])]
        columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["shard", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(placed: DataFrame, probe: np.ndarray, probe_ids: np.ndarray, tree, size: int, k: int) -> int:
    """The fewest visits with which the sampled queries reach ``RECALL``; all rows are searched."""

    def exact(batches):
        # the best so far of each sampled query: scores, ids and leaves, kept over all batches of the task
        top = [np.full((len(probe), k), -np.inf), np.full((len(probe), k), np.iinfo(np.int64).max), np.zeros((len(probe), k), np.int64)]
        for batch in batches:
            x, _ = _matrix(batch.column("v"), size)
            ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            scores = probe @ x.T
            scores[probe_ids[:, None] == ids] = -np.inf
            least = top[0].min(1)
            for i in np.flatnonzero(scores.max(1, initial=-np.inf) >= least):
                near = np.flatnonzero(scores[i] >= least[i])
                every = [np.concatenate([t[i], new]) for t, new in zip(top, (scores[i, near], ids[near], leaf[near]))]
                order = np.lexsort((every[1], -every[0]))[:k]
                for t, values in zip(top, every):
                    t[i] = values[order]
        at = np.nonzero(top[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(top[1][at]), pa.array(top[0][at]), pa.array(top[2][at], pa.int32())], ["query", "id", "score", "leaf"])

    best = placed.select("id", "v", "leaf").mapInArrow(exact, "query int, id long, score double, leaf int")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = best.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("query", "leaf").collect()  # k rows a query
    everything = len(tree.value.centres)
    depth = [{leaf: i for i, leaf in enumerate(tree.value.order(np.append(q, 0.0), everything))} for q in probe]
    deep = np.sort([depth[r["query"]][r["leaf"]] for r in true])
    return int(deep[min(len(deep) - 1, int(np.ceil(RECALL * len(deep))) - 1)]) + 1 if len(deep) else everything
