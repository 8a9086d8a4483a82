"""Exact top-k search by inner product: a KD-tree per shard, best-first traversal, kth scores that later searches inherit."""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.common import stored

#: Vectors of a shard and of a leaf, queries of a block, boxes of a pack.
SHARD, LEAF, BLOCK, PACK = 8192, 128, 512, 1024
#: Bounds of what the driver sees: sampled rows by which cells are cut, lengths of vectors that have cells, cells with a counted size.
SAMPLE, LENGTHS, COUNTED = 16_384, 4, 4096
CELL = 1 << 24


class Tree:
    """A KD-tree: median splits of the widest coordinate, a tight box round each node's vectors. Nodes 2i + 1 and 2i + 2 are below i."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int | None = None):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / (leaf or LEAF)))))
        self.first_leaf = (1 << depth) - 1
        nodes = 2 * self.first_leaf + 1
        self.low, self.high = np.zeros((nodes, vectors.shape[1])), np.zeros((nodes, vectors.shape[1]))
        self.bounds = np.zeros((nodes, 2), np.int64)
        self.cuts: dict[int, tuple[int, float]] = {}
        self._split(0, 0, len(ids))
        self.seen = 0

    def _split(self, node: int, a: int, b: int) -> None:
        self.bounds[node] = a, b
        if b > a:
            self.low[node], self.high[node] = self.vectors[a:b].min(axis=0), self.vectors[a:b].max(axis=0)
        if node >= self.first_leaf:
            return
        half = (a + b) // 2
        if b > a and self.vectors.shape[1]:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            order = a + np.argsort(self.vectors[a:b, axis], kind="stable")
            self.ids[a:b], self.vectors[a:b] = self.ids[order], self.vectors[order]
            self.cuts[node] = axis, float(self.vectors[half, axis])
        self._split(2 * node + 1, a, half)
        self._split(2 * node + 2, half, b)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the leaf on whose side of all cuts each vector lies."""
        at = np.zeros(len(vectors), np.int64)
        while self.cuts and (at < self.first_leaf).any():
            for node in np.unique(at).tolist():
                rows = np.flatnonzero(at == node)
                axis, cut = self.cuts[node]
                at[rows] = 2 * node + 1 + (vectors[rows, axis] >= cut)
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id) here, the query's own id left out, none below least (a kth score found elsewhere).

        A node's bound for a query is the largest inner product that any point of its box could have. The queries go together: nodes
        are taken in order of their bounds, a node by the queries alone whose kth score its bound reaches (at equal scores a smaller
        id may come), and a leaf is one matrix product of those. `seen` counts the pairs of query and vector that were multiplied.
        """
        n = len(queries)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        kth = least.astype(float).copy()
        open_: list = []

        def push(node: int, rows: np.ndarray) -> None:
            bound = up[rows] @ self.high[node] + down[rows] @ self.low[node]
            fine = bound >= kth[rows]
            if fine.any() and self.bounds[node, 1] > self.bounds[node, 0]:
                heapq.heappush(open_, (-bound[fine].max(), node, rows[fine], bound[fine]))

        push(0, np.arange(n))
        while open_:
            _, node, rows, bound = heapq.heappop(open_)
            rows = rows[bound >= kth[rows]]
            if not len(rows):
                continue
            if node < self.first_leaf:
                push(2 * node + 1, rows)
                push(2 * node + 2, rows)
                continue
            a, b = self.bounds[node]
            found = queries[rows] @ self.vectors[a:b].T
            self.seen += found.size
            found[query_ids[rows, None] == self.ids[None, a:b]] = -np.inf
            hits = ((found >= kth[rows, None]) & (found > -np.inf)).any(axis=1)
            rows, found = rows[hits], np.concatenate([scores[rows[hits]], found[hits]], axis=1)
            both = np.concatenate([ids[rows], np.broadcast_to(self.ids[a:b], (len(rows), b - a))], axis=1)
            first = np.lexsort((both, -found), axis=-1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(found, first, 1), np.take_along_axis(both, first, 1)
            kth[rows] = np.maximum(kth[rows], scores[rows, k - 1])
        return [[(int(s), i) for s, i in zip(a, b, strict=True) if s > -np.inf and s >= f] for a, b, f in zip(scores.tolist(), ids.tolist(), least.tolist(), strict=True)]


def quantized(vectors: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """key, v: floor(scale * component) as array<double>, and d, their number; rows without whole, finite vectors or without a key are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
    return rows.withColumn("d", F.size("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _in_cells(rows: DataFrame) -> DataFrame:
    """rows plus cell: where the vector lies among cells cut at the medians of a sample, about a shard each, 256 at most; 0 for vectors
    of a rare length."""
    common = {r["d"]: r["count"] for r in rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect() if r["count"] > SHARD}
    cutters = {}
    for d, n in common.items():
        sample = rows.where(F.col("d") == d).orderBy(F.xxhash64("key", "v"), "key").limit(SAMPLE).select("key", "v").collect()
        cutters[d] = Tree(np.array([r["key"] for r in sample]), np.array([r["v"] for r in sample], float).reshape(len(sample), d), leaf=max(SAMPLE // 256, len(sample) * SHARD // n))
    if not cutters:
        return rows.withColumn("cell", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d, cutter in cutters.items():
                some = np.flatnonzero(lengths == d)
                if len(some):
                    cell[some] = cutter.leaf_of(_matrix(batch.column(1).take(pa.array(some)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["key", "v", "d", "cell"])

    return rows.select("key", "v", "d").mapInArrow(run, "key long, v array<double>, d int, cell long")


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every`, the k other rows of the largest inner product.

    Components become floor(scale * x), so scores are integers (exact while they stay below 2**53). Ties go to the smaller key; a
    query with fewer than k other rows gets all. Vectors null, or holding null, NaN or infinity, take no part; vectors of another
    length than the query's aren't compared with it; empty ones score 0 with each other. Repeated keys: a query's own key is never
    its answer, and each row of a key counts. An empty table gives no rows.

    Rows are dealt into cells by cuts at a sample's medians, a cell into as many shards as its size asks for (a vector that a third
    of the rows share is a cell of many shards), one tree each. Queries travel in blocks: first to a shard of their own cell, whose
    kth scores then discard other shards by their boxes alone; only a pair of block and shard that a bound leaves open meets, and
    only answers that can still count come back.
    """
    rows = stored(_in_cells(stored(quantized(vectors, key, vector, scale), "vectors")), "cells")
    sizes = rows.groupBy("d", "cell").count().orderBy(F.desc("count"), "d", "cell").limit(COUNTED).collect()
    split = {f"{r['d']}:{r['cell']}": -(-r["count"] // SHARD) for r in sizes if r["count"] > SHARD}
    parts = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(split)), "map<string,int>"), F.concat_ws(":", "d", "cell")), F.lit(1))
    rows = rows.withColumn("parts", parts)
    number = lambda n: (F.col("cell") * CELL + F.pmod(F.xxhash64("key", "v"), n)).cast("long")

    def build(table: pa.Table) -> pa.Table:
        d, shard = table["d"][0].as_py(), table["shard"][0].as_py()
        tree = Tree(table["key"].to_numpy(), _matrix(table["v"], d).copy())
        return pa.table({"d": pa.array([d], pa.int32()), "shard": [shard], "low": [tree.low[0].tobytes()], "high": [tree.high[0].tobytes()], "tree": [pickle.dumps(tree, 5)]})

    def pack(table: pa.Table) -> pa.Table:
        d, block, home = (table[c][0].as_py() for c in ("d", "block", "home"))
        return pa.table({"d": pa.array([d], pa.int32()), "block": [block], "home": [home], "ids": [table["key"].to_numpy().tobytes()], "queries": [_matrix(table["v"], d).tobytes()]})

    trees = rows.withColumn("shard", number(F.col("parts"))).select("d", "shard", "key", "v").groupBy("d", "shard").applyInArrow(build, "d int, shard long, low binary, high binary, tree binary")
    trees = stored(trees, "trees")
    asked = rows.where(F.col("key") % every == 0).dropDuplicates(["key", "v"])
    asked = asked.withColumn("block", number(F.greatest(F.lit(1), F.ceil(F.col("parts") * SHARD / (every * BLOCK)))))
    asked = asked.withColumn("home", F.col("cell") * CELL + F.col("block") % CELL % F.col("parts"))
    blocks = stored(asked.select("d", "block", "home", "key", "v").groupBy("d", "block").applyInArrow(pack, "d int, block long, home long, ids binary, queries binary"), "queries")

    def arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(r.ids, np.int64)
        return ids, np.frombuffer(r.queries, float).reshape(len(ids), -1), np.frombuffer(r.least, float) if r.least is not None else np.full(len(ids), -np.inf)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tree = None, None
        for frame in frames:
            for r in frame.itertuples():
                if last != (r.d, r.shard):
                    last, tree = (r.d, r.shard), pickle.loads(r.tree)
                ids, queries, least = arrays(r)
                found = tree.search(queries, ids, k, least)
                full = [f[-1][0] if len(f) == k else -np.inf for f in found]
                answers = [{"query_id": q, "vec_id": i, "score": s, "n": n} for n, (q, f) in enumerate(zip(ids.tolist(), found, strict=True)) for s, i in f]
                yield pd.DataFrame({"d": r.d, "block": r.block, "kth": [np.array(full, float).tobytes()], "answers": [answers]})

    shape = "d int, block long, kth binary, answers array<struct<query_id:long,vec_id:long,score:long,n:int>>"
    first = blocks.withColumnRenamed("home", "shard").join(trees.select("d", "shard", "tree"), ["d", "shard"]).withColumn("least", F.lit(None).cast("binary"))
    # a block whose home shard is empty searches all others without a bound
    first = stored(first.select("d", "shard", "block", "tree", "ids", "queries", "least").mapInPandas(search, shape), "first")
    bounded = blocks.join(first.select("d", "block", F.col("kth").alias("least")), ["d", "block"], "left")

    def boxes(table: pa.Table) -> pa.Table:
        both = {c: [b"".join(table[c].to_pylist())] for c in ("low", "high")}
        return pa.table({"d": pa.array([table["d"][0].as_py()], pa.int32()), "pack": pa.array([table["pack"][0].as_py()], pa.int64()), "shards": [table["shard"].to_numpy().tobytes()], **both})

    packs = -(-max(1, trees.count()) // PACK)
    packed = trees.select("d", F.pmod(F.xxhash64("shard"), F.lit(packs)).alias("pack"), "shard", "low", "high")
    packed = packed.groupBy("d", "pack").applyInArrow(boxes, "d int, pack long, shards binary, low binary, high binary")
    met = bounded.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).join(packed, ["d", "pack"])

    def reachable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                ids, queries, least = arrays(r)
                shards = np.frombuffer(r.shards, np.int64)
                low, high = (np.frombuffer(x, float).reshape(len(shards), -1) for x in (r.low, r.high))
                bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
                some = (bound >= least[:, None]).any(axis=0) & ((shards != r.home) | (r.least is None))
                yield pd.DataFrame({"d": np.int32(r.d), "block": r.block, "shard": shards[some]})

    pairs = met.select("d", "block", "home", "ids", "queries", "least", "shards", "low", "high").mapInPandas(reachable, "d int, block long, shard long")
    pairs = stored(pairs, "pairs").join(bounded.drop("home"), ["d", "block"]).join(trees.select("d", "shard", "tree").hint("shuffle_hash"), ["d", "shard"])
    rest = pairs.select("d", "shard", "block", "tree", "ids", "queries", "least").mapInPandas(search, shape)
    # Two queries may share a key if their vectors differ: their answers are ranked apart, by the place in the block.
    answers = first.unionByName(rest).select("d", "block", F.explode("answers").alias("a")).select("d", "block", "a.*")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("d", "block", "n").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
