"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched through one priority
queue over all of its trees, then exact scores of all vectors in the leaves that were reached.

The trees' splits are fitted on a bounded sample and broadcast; every vector is routed down every tree, so that a leaf's
members are a shuffle key. A query's leaves meet the leaf's vectors in a sorted, streamed partition: vectors of a block
of a leaf first (BLOCK at most, larger leaves are dealt into several), then the queries one batch after another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, map_arrow, prepared, table
from shotlens.session import materialise

#: Vectors that the trees are fitted on: SAMPLE, more where the table's number of leaves needs more, MAX_SAMPLE at most. Up to
#: LEAF * MAX_SAMPLE / LEAF_SAMPLE vectors (16 million) the leaves keep their size; beyond that they grow with the table.
SAMPLE, MAX_SAMPLE = 16_384, 262_144
#: Trees, sample vectors of a leaf at least, vectors of a leaf aimed at.
TREES, LEAF_SAMPLE, LEAF = 2, 8, 512
#: Vectors of a leaf that one task holds at a time at most.
BLOCK = 16_384
#: Queries whose best a task holds at a time at most.
HELD = 20_000
#: Queries on which the number of leaves is chosen, and the share of true neighbours that it has to reach there.
TUNING, RECALL = 128, 0.94
SALTS = 32


@dataclass
class Forest:
    """Complete binary trees as arrays: node i has the children 2i + 1 and 2i + 2. Bounded by MAX_SAMPLE and TREES."""

    normals: np.ndarray  # (trees, inner nodes, dimensions)
    offsets: np.ndarray  # (trees, inner nodes)
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def route(self, x: np.ndarray) -> np.ndarray:
        """(trees, vectors): the number of each vector's leaf, over all trees."""
        out = np.zeros((len(self.normals), len(x)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + right
            out[t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order in which the shared queue yields them: a branch's key is the least margin on its way."""
        margins = np.einsum("tij,j->ti", self.normals, q) - self.offsets
        inner, c, found = self.leaves - 1, 0, []
        heap = [(-np.inf, t, t, 0) for t in range(len(self.normals))]
        c = len(heap)
        while heap and len(found) < most:
            key, _, t, node = heapq.heappop(heap)
            while node < inner:  # down the nearer side; the other side waits in the queue
                m = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (max(key, abs(m)), c, t, far))
                c += 1
                node = near
            found.append(node - inner + t * self.leaves)
        return found


def fit_forest(x: np.ndarray, total: int, trees: int = TREES, seed: int = 5) -> Forest:
    """Splits between the means of two halves that grow out of two random vectors, at the median of the projections."""
    rng = np.random.default_rng(seed)
    depth = int(max(0, min(np.log2(max(1, len(x) / LEAF_SAMPLE)), np.log2(max(1, total / LEAF)))))
    inner, dim = (1 << depth) - 1, x.shape[1]
    normals, offsets = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(x))}
        for node in range(inner):
            at = members.pop(node)
            normal = rng.normal(size=dim)
            if len(at) > 1:
                a, b = x[rng.choice(at, 2, replace=False)]
                for _ in range(4):
                    if np.array_equal(a, b):
                        break
                    side = x[at] @ (a - b)
                    hi = side > np.median(side)
                    if hi.all() or not hi.any():
                        break
                    a, b = x[at[hi]].mean(0), x[at[~hi]].mean(0)
                if not np.array_equal(a, b):
                    normal = a - b
            normal /= np.linalg.norm(normal)
            side = x[at] @ normal
            cut = np.median(side) if len(at) else 0.0
            normals[t, node], offsets[t, node] = normal, cut
            members[2 * node + 1], members[2 * node + 2] = at[side <= cut], at[side > cut]
    return Forest(normals, offsets, depth)


def usable(vec: Column, dim: int | None = None) -> Column:
    x = vec.cast("array<double>")
    ok = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(vec) == dim), F.lit(False))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """vec, ids (the k + 1 smallest of those with this vector) and key (the smallest). As they all have one score, no
    more of them can be among a query's k nearest. Hot vectors are cut down in salted parts first."""
    part = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))).where(F.col("rank") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_list("id")), 1, k + 1)  # of SALTS * (k + 1) ids at most
    return ranked.groupBy("vec").agg(ids.alias("ids")).withColumn("key", F.col("ids")[0])


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate gives all vectors one length, by which nearest in angle is largest in inner product."""
    return np.hstack([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))[:, None]])


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of the k largest scores, and all that equal the last of them."""
    if scores.shape[1] <= k:
        return scores > -np.inf
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    return scores >= kth - 1e-9 * np.abs(kth)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows: the same pair always gives the same bits, wherever it stands."""
    return np.array([float(np.add.reduce(x * y)) for x, y in zip(a, b, strict=True)])


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, `id_col` and score of the k nearest found to each row for which `queries` holds, of all other rows.

    Nearness is the largest inner product in double precision; ties go to the smaller id. Vectors that are null, zero,
    of another length than most, or hold a null or non-finite component take no part, nor do rows with a null id. A
    repeated row counts once; an id that comes with several vectors has the least of them. With fewer than k candidates
    all are returned; an empty table gives an empty table; further columns are not read. The number of leaves is chosen
    so that TUNING queries find the share `recall` of their true neighbours, which a scan of all vectors tells.
    """
    prepared(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    good = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    size = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    if size is None:
        return spark.createDataFrame([], schema)
    rows = materialise(spark, good.where(F.size("vec") == size["n"]).groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")), "vectors")
    data = materialise(spark, distinct_vectors(rows.select("id", "vec"), k), "distinct")
    asking = rows.where("asks").select("id", "vec")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    total, longest = data.agg(F.count("*"), F.max(norm)).head()
    size = min(MAX_SAMPLE, max(SAMPLE, LEAF_SAMPLE * total // LEAF))
    sample = data.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(size).select("vec").toArrow()  # MAX_SAMPLE rows at most
    forest = fit_forest(lift(np.asarray(sample.column(0).combine_chunks().flatten(), np.float64).reshape(sample.num_rows, -1), longest), total)
    shared = spark.sparkContext.broadcast(forest)
    leaves = _leaves_for(spark, shared, data, asking, k, longest, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            at = f.route(lift(matrix(b, "vec"), longest))
            every = pa.array(np.tile(np.arange(b.num_rows), len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), *(b.column(b.schema.get_field_index(c)).take(every) for c in ("key", "vec", "ids"))], names=["leaf", "key", "vec", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = matrix(b, "vec")
            q = np.hstack([x, np.zeros((len(x), 1))])
            q *= longest / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for at in range(0, len(q), 256):
                found = [f.order(v, leaves) for v in q[at : at + 256]]
                row = pa.array(np.repeat(np.arange(at, at + len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array([i for x in found for i in x], pa.int64()), *(b.column(b.schema.get_field_index(c)).take(row) for c in ("id", "vec"))], names=["leaf", "key", "vec"])

    members = materialise(spark, map_arrow(data, route, f"leaf long, key {kind}, vec array<double>, ids array<{kind}>"), "leaves")
    sizes = members.groupBy("leaf").count().where(F.col("count") > BLOCK).collect()  # leaves are bounded by MAX_SAMPLE
    blocks = {r["leaf"]: -(-r["count"] // BLOCK) for r in sizes}
    many = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for p in blocks.items() for x in p)), F.col("leaf")), F.lit(1)) if blocks else F.lit(1)
    probes = map_arrow(asking.repartition(spark.sparkContext.defaultParallelism), ask, f"leaf long, key {kind}, vec array<double>")
    both = members.select("leaf", F.pmod(F.xxhash64("key"), many.cast("long")).alias("block"), F.lit(0).alias("asks"), "key", "vec", "ids").unionByName(
        probes.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).alias("block"), F.lit(1).alias("asks"), "key", "vec", F.lit(None).cast(f"array<{kind}>").alias("ids"))
    )
    dealt = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, x, ids = None, [], None, None
        held: dict[object, dict[object, tuple[float, list]]] = {}  # of each query: its best vectors by key

        def out() -> pa.RecordBatch:
            rows = [(q, i, s) for q, best in held.items() for s, i in best.values()]
            held.clear()
            q, i, s = zip(*rows, strict=True)
            return batch_of(query_id=pa.array(q, kinds[0]), ids=pa.array(i, kinds[1]), score=pa.array(s, pa.float64()))

        for b in batches:
            kinds = b.column(3).type, b.column(5).type
            leaf, block, asks = (np.asarray(b.column(i)) for i in range(3))
            v, key, lists = matrix(b, "vec"), b.column(3).to_pylist(), b.column(5)
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(leaf)], strict=True):
                if (leaf[lo], block[lo]) != at:
                    at, parts, x = (leaf[lo], block[lo]), [], None
                if not asks[lo]:
                    parts.append((v[lo:hi], lists.slice(lo, hi - lo).to_pylist()))
                    continue
                if not parts and x is None:
                    continue
                if x is None:
                    x, ids, parts = np.concatenate([p[0] for p in parts]), [i for p in parts for i in p[1]], []
                for s in range(lo, hi, 512):
                    e = min(hi, s + 512)
                    qi, vi = np.nonzero(best_rows(v[s:e] @ x.T, k + 1))
                    touched = set()
                    for q, n, score in zip((s + qi).tolist(), vi.tolist(), exact(v[s:e][qi], x[vi]).tolist(), strict=True):
                        held.setdefault(key[q], {})[ids[n][0]] = (score, ids[n])
                        touched.add(key[q])
                    for q in touched:
                        if len(held[q]) > 2 * (k + 1):  # equal scores at the end stay together
                            kth = sorted((-c[0] for c in held[q].values()))[k]
                            held[q] = {n: c for n, c in held[q].items() if -c[0] <= kth}
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    found = map_arrow(dealt, search, f"query_id {kind}, ids array<{kind}>, score double")
    once = found.groupBy("query_id", F.col("ids")[0].alias("key")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    each = once.select("query_id", F.explode("ids").alias("id"), "score").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _leaves_for(spark: SparkSession, shared: Broadcast, data: DataFrame, asking: DataFrame, k: int, longest: float, recall: float) -> int:
    """The least number of leaves in the queue's order at which TUNING queries find the share `recall` of the k vectors
    that a scan of all vectors but their own finds for them."""
    forest: Forest = shared.value
    picked = asking.orderBy(F.xxhash64("id"), "id").limit(TUNING).toArrow()  # TUNING rows
    if not picked.num_rows or forest.depth == 0:
        return TREES * forest.leaves
    own = picked.column("id").to_pylist()
    q = np.array(picked.column("vec").to_pylist())
    sent = spark.sparkContext.broadcast((own, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        held: list[list[tuple[float, list[int]]]] = [[] for _ in ids]
        for b in batches:
            x = matrix(b, "vec")
            at = shared.value.route(lift(x, longest)).T
            for i, js in enumerate(best_rows(q @ x.T, k + 1)):
                held[i] += [(float(q[i] @ x[j]), at[j].tolist()) for j in np.flatnonzero(js) if not np.array_equal(q[i], x[j])]
                held[i].sort(reverse=True)
                del held[i][k:]
        for i, h in enumerate(held):
            if h:
                yield batch_of(q=pa.array([i] * len(h), pa.int64()), score=pa.array([s for s, _ in h]), leaves=pa.array([x for _, x in h], pa.list_(pa.int64())))

    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaves"))
    got = map_arrow(data.select("vec"), scan, "q long, score double, leaves array<long>").withColumn("r", top).where(F.col("r") <= k).toArrow().to_pydict()  # TUNING * k rows
    q = np.hstack([q, np.zeros((len(q), 1))])
    q *= longest / np.linalg.norm(q, axis=1, keepdims=True)
    places = [{leaf: n for n, leaf in enumerate(forest.order(v, TREES * forest.leaves))} for v in q]
    needed = sorted(min(places[i][leaf] for leaf in leaves) + 1 for i, leaves in zip(got["q"], got["leaves"], strict=True)) or [1]
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
