"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately with CENTROIDS centroids
each, so a cell is a pair of centroids. A query walks the pairs in order of
summed distance with a heap (the multi-sequence walk) until the cells reached
hold its share of the index, and the entries of those cells are ranked by
their exact distance.

Equal vectors are one entry with its smallest ids, so a vector that many rows
share costs no more than another. Cells and queries meet by the cells' first
centroid, whose cells a query's list picks from, so that a task returns k + 1
entries a query; one beyond CELL_ROWS entries is dealt into slices, and more than QUERY_ROWS
queries into blocks, so that a task holds one slice and one block. Codebooks come from a bounded sample, chosen by a hash of the
id; every row is indexed.

Defined results: vectors that are null, zero, of another length than most, or
that hold a null or non-finite component take no part, as query or candidate;
ties go to the smaller id; fewer candidates than asked for are all returned;
rows repeating an id and vector count once; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import checkpointed

CENTROIDS = 64
#: Rows that the codebooks are fitted on at most.
TRAIN_ROWS = 20_000
#: Share of the distinct vectors, and least number, that a query's walk reaches.
SHARE = 0.45
LEAST = 1_000
CELL_ROWS = 4_096
#: Distinct query vectors that meet a slice of a cell in one task at most, on average.
QUERY_ROWS = 8_192
SEED = 7


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    base = base.where(~bad & some)
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return base.where(F.size("v") == (common["d"] if common else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def walk(near: np.ndarray, far: np.ndarray, count: np.ndarray, enough: int) -> list[int]:
    """Cells i * K + j in order of near[i] + far[j], until they hold ``enough`` entries."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, seen, out, held = [(near[a[0]] + far[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(far) + int(b[j])
        if count[cell]:
            out.append(cell)
            held += int(count[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (near[a[x]] + far[b[y]], x, y))
    return out


def _matrix(column) -> np.ndarray:
    return np.array(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(len(column), -1)


def search(embeddings: DataFrame, k: int = 10, every: int = 100, share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each vector whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = usable(embeddings).distinct().withColumn("key", F.xxhash64("v"))
    # Of equal vectors the k + 1 smallest ids are enough: a query leaves out at most its own.
    ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    ranked = checkpointed(ranked)
    entries = ranked.where("copy = 1").select("key", "v")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rate = min(1.0, 1.2 * TRAIN_ROWS / total)
    sample = entries.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < rate * (1 << 20)).limit(TRAIN_ROWS)
    x = np.array([r.v for r in sample.orderBy("key").toLocalIterator()], np.float64)
    half = max(1, x.shape[1] // 2)
    books = [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0))]
    width = len(books[1])
    shared = spark.sparkContext.broadcast(books)

    def assign(batches):
        first, second = shared.value
        for batch in batches:
            v = _matrix(batch.column(1))
            if len(v):
                cell = nearest(v[:, :half], first) * len(second) + nearest(v[:, half:], second)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "key", "v"])

    index = checkpointed(entries.mapInArrow(assign, "cell int, key long, v array<double>"))
    # At most centroids squared numbers.
    count = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():
        count[r["cell"]] = r["count"]
    enough = max(LEAST, int(np.ceil(share * total)))
    slices = -(-count.reshape(-1, width).sum(1) // CELL_ROWS)

    def visit(batches):
        first, second = shared.value
        for batch in batches:
            v = _matrix(batch.column(1))
            out = [[], [], [], []]
            for row, q in enumerate(v):
                reached = walk(((first - q[:half]) ** 2).sum(1), ((second - q[half:]) ** 2).sum(1), count, enough)
                ring: dict[int, list[int]] = {}
                for cell in reached:
                    ring.setdefault(cell // width, []).append(cell % width)
                for i, js in ring.items():
                    for part in range(int(slices[i])):
                        for to, value in zip(out, (i, part, row, js)):
                            to.append(value)
            at = pa.array(out[2], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(out[3], pa.list_(pa.int32()))], names=["row", "part", "query", "v", "cells"])

    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.groupBy("key").agg(F.first("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    visits = queries.mapInArrow(visit, "row int, part int, query long, v array<double>, cells array<int>").select("row", "part", block, "query", "v", "cells")
    in_row = (F.col("cell") / width).cast("int")
    parts = F.lit(1) if slices.max() <= 1 else F.element_at(F.array(*[F.lit(max(1, int(s))) for s in slices]), in_row + 1)
    dealt = index.select(in_row.alias("row"), (F.col("cell") % width).alias("cell"), F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "key", "v")

    def rerank(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = _matrix(left.column("v")), _matrix(right.column("v"))
        ids, keys, cell = left.column("query").to_numpy(), right.column("key").to_numpy(), right.column("cell").to_numpy()
        out = [[], [], []]
        for row, (one, reached) in enumerate(zip(q, left.column("cells").to_pylist())):
            own = np.zeros(width, bool)
            own[reached] = True
            at = np.flatnonzero(own[cell])
            if not len(at):
                continue
            d = np.sqrt(((v[at] - one) ** 2).sum(1))
            best = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
            out[0].append(np.full(len(best), ids[row]))
            out[1].append(keys[at[best]])
            out[2].append(d[best])
        a, b, c = (np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, (np.int64, np.int64, np.float64)))
        return pa.table({"query": pa.array(a), "key": pa.array(b), "score": pa.array(c)})

    groups = ("row", "part", "block")
    found = visits.groupBy(*groups).cogroup(dealt.groupBy(*groups)).applyInArrow(rerank, "query long, key long, score double")
    # Of a query vector, entries at the (k + 1)-th distance or nearer; ties all stay until ids decide.
    order = Window.partitionBy("query").orderBy("score")
    found = found.withColumn("r", F.rank().over(order)).where(F.col("r") <= k + 1)
    answers = found.join(ranked.select("key", "vec_id"), "key").select("query", "vec_id", "score")
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query"))
    pairs = each.join(answers, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
