"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each document becomes a vector of statistics of its bytes, words and lines.
Random Fourier features approximate a Gaussian kernel over the standardised
statistics. Every partition of the labelled training rows sums its part of the
normal equations; the sums are added up, and one small system is solved. The
fitted scores are counted in fixed bins by label, and pooling adjacent
violators turns the bins into a non-decreasing probability.

Defined results: null and empty texts have all-zero statistics and are scored
like any other; documents labelled several times count that often in training;
with no labels every score is 0.5; repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow_text import SPACE_TABLE, chunks, prefix_hash, span_hash, text_view, words
from marginalia.llm.language_id import held_out
from marginalia.session import checkpointed

FEATURES = 256
WIDTH = 1.0  # of the kernel, in units of the square root of the number of statistics
RIDGE = 1e-3
BINS = 512
SEED = 20240229
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "long_words", "letters", "digits", "capitals", "beyond_ascii",
    "stops", "commas", "marks", "pipes", "symbols", "words_ending_in_symbol", "same_word_again", "distinct_words",
    "distinct_pairs", "repeated_lines", "mean_line", "short_words", "spaces",
)


def _kinds() -> np.ndarray:
    """Per byte: a bit for each kind of character that is counted."""
    kind = np.zeros(256, np.uint16)
    for bit, own in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "", ".!?", ",;:", "!?", "|", "#$%&*+<=>@[]^_{}~\\/", " \t\r\n\x0b\x0c")):
        kind[np.frombuffer(own.encode(), np.uint8)] |= 1 << bit
    kind[128:] |= 1 << 3
    return kind


_KINDS = _kinds()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each [bounds[i], bounds[i+1]), empty ranges being 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each owner."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document of a block."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kind = _KINDS[data]
    count = [_sums((kind >> bit) & 1, offsets) for bit in range(10)]
    starts, ends, first = words(data, offsets, SPACE_TABLE)
    owner = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    prefix = prefix_hash(data)
    key = span_hash(prefix, starts, ends)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    pair = key[:-1] * np.uint64(3) + key[1:] if len(key) else key
    inner = owner[:-1] == owner[1:]
    last = (kind[ends - 1] >> 8) & 1 if len(ends) else np.zeros(0)
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_key = span_hash(prefix, line_start, np.maximum(line_start, line_end - (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else line_end))
    n_lines = np.bincount(line_owner, minlength=n).astype(np.float64)
    one = lambda x, of: x / np.maximum(of, 1)
    columns = (
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), one(_sums(length, first), n_words), one(_sums(length > 12, first), n_words),
        one(count[0], size), one(count[1], size), one(count[2], count[0]), one(count[3], size),
        one(count[4], n_words), one(count[5], n_words), one(count[6], n_words), one(count[7], n_words), one(count[8], n_words),
        one(_sums(last, first), n_words), one(_sums(again, first), n_words), one(_distinct(key, owner, n), n_words),
        one(_distinct(pair[inner], owner[:-1][inner], n), n_words), 1 - one(_distinct(line_key, line_owner, n), n_lines),
        np.log1p(one(size, n_lines)), one(_sums(length <= 3, first), n_words), one(count[9], size),
    )
    return np.column_stack(columns)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for lo, hi in chunks(offsets, 1 << 20):
                rows = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values], names=["doc_id", "stats"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class KernelModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    edges: tuple[float, float] = (0.0, 1.0)
    level: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(Wx + b), and a constant."""
        d = len(self.mean)
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((stats - self.mean) / self.scale, -6, 6) @ w + b)
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def bin(self, raw: np.ndarray) -> np.ndarray:
        low, high = self.edges
        return np.clip(((raw - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(self.level[self.bin(self.raw(stats))], 0.0, 1.0)


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ``good`` by pooling adjacent violators; empty bins take their neighbours' course."""
    blocks: list[list[float]] = []
    at = np.flatnonzero(total > 0)
    for i in at:
        blocks.append([good[i], total[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + t, blocks[-1][2] + n]
    level = np.concatenate([np.full(int(n), g / t) for g, t, n in blocks]) if blocks else np.zeros(0)
    return np.interp(np.arange(len(total)), at, level) if len(at) else np.full(len(total), 0.5)


def _stacked(column) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def fit(measured: DataFrame, labels: DataFrame) -> KernelModel:
    """Fit on all labelled rows of the training fold; only sums of fixed size reach the driver."""
    d = len(STATISTICS)
    train = measured.where(~held_out()).join(labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").select("stats", "y")
    train = checkpointed(train)

    def moments(batches):
        total = np.zeros(2 * d + 1)
        for batch in batches:
            x = _stacked(batch.column(0))
            total += np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    def added(df, run, size):
        out = np.zeros(size)
        for r in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        return out

    m = added(train, moments, 2 * d + 1)
    if m[0] == 0:
        return KernelModel(np.zeros(d), np.ones(d))
    mean = m[1 : d + 1] / m[0]
    scale = np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 0))
    model = KernelModel(mean, np.where(scale > 1e-9, scale, 1.0))
    k = FEATURES + 1

    def normal(batches):
        total = np.zeros((k, k + 1))
        for batch in batches:
            z, y = model.features(_stacked(batch.column(0))), np.array(batch.column(1))
            total[:, :k] += z.T @ z
            total[:, k] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    # Few partitions hold compact rows, so that what is summed stays a small share of the input.
    packed = train.coalesce(16)
    a = added(packed, normal, k * (k + 1)).reshape(k, k + 1)
    model.weights = np.linalg.solve(a[:, :k] + RIDGE * m[0] * np.eye(k) / k, a[:, k])
    model.edges = (-0.5, 1.5)

    def counted(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            at, y = model.bin(model.raw(_stacked(batch.column(0)))), np.array(batch.column(1))
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, weights=y, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * BINS), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    total, good = added(packed, counted, 2 * BINS).reshape(2, BINS)
    model.level = isotonic(total, good)
    return model


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; texts are read once."""
    measured = checkpointed(measure(documents))
    shared = documents.sparkSession.sparkContext.broadcast(fit(measured, labels))

    def run(batches):
        model = shared.value
        for batch in batches:
            s = model.score(_stacked(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
