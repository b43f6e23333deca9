"""Exact k-means over integer vectors, filtered by partition-local ball trees.

Vectors are scaled to integers. Each partition packs its vectors into blocks
of at most BLOCK_ROWS and builds a tree of balls over each block; a ball has a
pivot, a radius, a count and an integer sum. Blocks are written once and read
in every round. A round takes the centroids down the trees: where the nearest
centroid of a ball's pivot is nearer than any other by more than twice the
radius, the triangle inequality gives it the whole ball, whose count and sum
are added unread; other balls are opened, and the vectors of open leaves are
compared one by one in exact integer arithmetic. A task holds one block, a
round returns one row of counts and sums a task and centroid, and nothing is
shuffled by vector or cluster, so copies and large clusters weigh on no task.

Defined results: a vector with another number of components than asked for, or
with a null or non-finite one, takes no part, nor does one with a component
whose integer is beyond 2**26, as squared distances must fit 64 bits; ties go
to the smaller cluster; fewer vectors than centroids give as many centroids as
there are vectors; repeated rows each count; rows repeating an id with other
vectors start in the order of their components; a null id never starts a
cluster before others; an empty table gives no rows. Sums of distances beyond
64 bits are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import checkpointed, dropped, stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Vectors of a block, and of a leaf at most.
BLOCK_ROWS, LEAF_ROWS = 4_096, 16
#: Largest component; below SAFE all products are exact as doubles, too.
LARGEST, SAFE = 1 << 26, 1 << 22
MOST = (1 << 63) - 1


def kept(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<bigint>, the scaled components' floors) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dimensions)
    # NaN is larger than every number, and comparing null gives null, so neither passes.
    fits = F.forall("v", lambda x: F.coalesce(F.abs(x * scale) < LARGEST, F.lit(False)))
    return rows.where(fits).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c, as 64-bit integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < SAFE:
        # Every sum stays under 2**53 (for up to 512 components), so doubles hold it exactly.
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class BallTree:
    """Balls over the rows of an integer matrix, which is put in the order of the leaves.

    Ball i covers rows start[i] to stop[i] and has two children, or none (-1).
    """

    def __init__(self, x: np.ndarray):
        order = np.arange(len(x))
        start, stop, child = [0], [len(x)], [-1]
        for i in iter(range(1 << 62)):
            if i == len(start):
                break
            lo, hi = start[i], stop[i]
            own = x[order[lo:hi]]
            spread = own.max(0) - own.min(0)
            if hi - lo <= LEAF_ROWS or not spread.any():
                continue
            # Halves along the widest component.
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(spread.argmax())], half)]
            child[i] = len(start)
            start += [lo, lo + half]
            stop += [lo + half, hi]
            child += [-1, -1]
        self.order = order
        self.start, self.stop, self.child = (np.array(a, np.int32) for a in (start, stop, child))
        sums = np.zeros((len(x) + 1, x.shape[1]), np.int64)
        np.cumsum(x[order], axis=0, out=sums[1:])
        self.sum = sums[self.stop] - sums[self.start]
        self.pivot = self.sum // np.maximum(self.stop - self.start, 1)[:, None]
        self.radius = np.array([np.sqrt(float(distances(x[order[a:b]], p[None]).max(initial=0))) for a, b, p in zip(start, stop, self.pivot)])


def pack(ids: list, x: np.ndarray) -> dict:
    """A block's row: its vectors in the order of the tree's leaves, and the tree's arrays, as little-endian bytes."""
    tree = BallTree(x)
    own = {"start": tree.start, "stop": tree.stop, "child": tree.child, "pivot": tree.pivot.astype("<i4"), "total": tree.sum.astype("<i8"), "radius": tree.radius.astype("<f8")}
    return {"ids": [ids[i] for i in tree.order], "vectors": x[tree.order].astype("<i4").tobytes()} | {k: v.tobytes() for k, v in own.items()}


BLOCK = "ids array<long>, vectors binary, start binary, stop binary, child binary, pivot binary, total binary, radius binary"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("vectors", "start", "stop", "child", "pivot", "total", "radius"))])
_KINDS = {"vectors": "<i4", "start": "<i4", "stop": "<i4", "child": "<i4", "pivot": "<i4", "total": "<i8", "radius": "<f8"}


def blocks(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The vectors as rows of BLOCK, each with its tree; a partition's vectors stay in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def flush(n: int) -> pa.RecordBatch:
            nonlocal ids, held
            x = np.concatenate(held)
            row = pack(ids[:n], x[:n])
            ids, held = ids[n:], [x[n:]]
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(batch.column(1).flatten().to_numpy().reshape(-1, dimensions))
            while len(ids) >= BLOCK_ROWS:
                yield flush(BLOCK_ROWS)
        if ids:
            yield flush(len(ids))

    return vectors.select("vec_id", "v").mapInArrow(run, BLOCK)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    """(ids, arrays) of each block of a batch."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        arrays = {c: np.frombuffer(batch.column(names.index(c))[i].as_py(), kind) for c, kind in _KINDS.items()}
        width = len(arrays["total"]) // max(len(arrays["start"]), 1)
        for c in ("vectors", "pivot", "total"):
            arrays[c] = arrays[c].reshape(-1, width).astype(np.int64)
        yield batch.column(names.index("ids"))[i].values, arrays


def descend(block: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their clusters, rows, their clusters): balls that go whole to a centroid, and the rows compared one by one."""
    balls, ball_clusters, open_rows = [], [], []
    level = np.zeros(1, np.int64)
    while len(level):
        apart = np.sqrt(distances(block["pivot"][level], centroids).astype(np.float64))
        near = apart.argmin(1)
        at = np.arange(len(level))
        first = apart[at, near].copy()
        apart[at, near] = np.inf
        # Roots and sums of doubles are off by less than this margin.
        margin = 1e-9 * (1 + apart.min(1, initial=np.inf, where=np.isfinite(apart)) + first)
        sure = apart.min(1) - first > 2 * block["radius"][level] + np.where(np.isfinite(margin), margin, 0)
        balls.append(level[sure])
        ball_clusters.append(near[sure])
        rest = level[~sure]
        children = block["child"][rest]
        open_rows += [np.arange(a, b) for a, b in zip(block["start"][rest[children < 0]], block["stop"][rest[children < 0]])]
        inner = children[children >= 0].astype(np.int64)
        level = np.concatenate([inner, inner + 1])
    rows = np.concatenate(open_rows) if open_rows else np.zeros(0, np.int64)
    clusters = distances(block["vectors"][rows], centroids).argmin(1) if len(rows) else np.zeros(0, np.int64)
    return np.concatenate(balls), np.concatenate(ball_clusters), rows, clusters


def moved(blocks_table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: of each with vectors the floors of its mean; others stay."""
    k, width = centroids.shape
    held = blocks_table.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, block in unpacked(batch):
                balls, of, rows, clusters = descend(block, held.value)
                np.add.at(count, of, block["stop"][balls] - block["start"][balls])
                np.add.at(total, of, block["total"][balls])
                np.add.at(count, clusters, 1)
                np.add.at(total, clusters, block["vectors"][rows])
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = blocks_table.mapInArrow(run, "cluster int, n long, total array<long>")
    summed = parts.select("cluster", "n", F.posexplode("total").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for row in summed.collect():  # one row a component of a centroid
        out[row["cluster"], row["j"]] = int(row["s"]) // row["n"]
    held.unpersist()
    return out


def assigned(blocks_table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    held = blocks_table.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in unpacked(batch):
                balls, of, rows, clusters = descend(block, held.value)
                cluster = np.empty(len(ids), np.int32)
                for a, b, c in zip(block["start"][balls], block["stop"][balls], of):
                    cluster[a:b] = c
                cluster[rows] = clusters
                distance = ((block["vectors"] - held.value[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return blocks_table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(assignment, centroids): vec_id, cluster and distance of every vector kept, and the centroids that gave them.

    The assignment is a checkpoint. The first centroids are the k vectors whose
    ids have the smallest SHA-256.
    """
    spark = embeddings.sparkSession
    vectors = kept(embeddings, dimensions, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    table = stored(blocks(vectors, dimensions))
    for _ in range(rounds):
        centroids = moved(table, centroids)
    out = checkpointed(assigned(table, centroids))
    dropped(table)
    return out, centroids


def report(assignment: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with the summed distances of its cluster and of all, and the SHA-256 of its centroid's components."""
    spark = assignment.sparkSession
    held = assignment.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    whole = sum(int(r["s"]) for r in held)
    rows = [(r["cluster"], min(int(r["s"]), MOST), min(whole, MOST), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in held]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assignment.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
