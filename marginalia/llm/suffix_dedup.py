"""Repeated long substrings by suffix order and longest-previous-factor arrays.

``longest_previous_factor`` is the method on one buffer: in suffix order, the
nearest earlier-starting suffix before and after each suffix (previous and next
smaller position) hold its longest match that starts earlier.

Over a corpus, only places that can repeat are put in suffix order. Each window
of ``length`` bytes is named by its minimiser (the k-gram of least hash), so
equal windows anywhere have equal anchors at equal offsets. Anchors meet by
their k-gram; an anchor whose whole context (all bytes of its windows) occurs
twice is settled by its hash. Only where contexts of one anchor differ (at the
edges of repeats) their bytes are brought together, sorted as suffixes of
bounded depth, and neighbours in suffix order show which windows occur again.

Defined results: null counts as empty; texts shorter than ``length`` keep all;
a text that occurs twice and is long enough goes wholly; rows with one doc_id
are each reported; an empty table gives an empty result; extra columns are
ignored. Texts, contexts and anchors are told apart by 64-bit hashes of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.arrow_text import U, chunks, mix, prefix_hash, span_hash, text_view
from marginalia.llm.jaccard_join import prefiltered
from marginalia.session import checkpointed, release

LENGTH = 200
GRAM = 40
#: Bytes of contexts that are put in suffix order at once.
BLOCK_BYTES = 1 << 20
#: Anchors with more different contexts than this are settled window by window instead.
HOT_CONTEXTS = 20_000


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` bytes (all bytes, if None); equal prefixes share a rank."""
    n = len(data)
    depth = depth or max(n, 1)
    have, rank = 8, None
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + U(1)
    if depth < 7:
        have = depth
        code = sum((padded[k : n + k] * U(257) ** U(have - 1 - k) for k in range(have)), np.zeros(n, np.uint64))
    else:
        have = 7  # seven symbols of nine bits
        code = np.zeros(n, np.uint64)
        for k in range(7):
            code = (code << U(9)) | padded[k : n + k]
    rank = _dense(code)
    while have < depth and len(rank) and rank.max() < n - 1:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        rank = _dense(rank * (n + 2) + after)
        have += step
    return rank


def _dense(code: np.ndarray) -> np.ndarray:
    order = np.argsort(code)
    ordered = code[order]
    step = np.ones(len(code), bool)
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(code), np.int64)
    rank[order] = np.cumsum(step) - 1
    return rank


def longest_previous_factor(data: bytes) -> np.ndarray:
    """For each position, the length of its longest match that starts earlier."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    order = np.argsort(suffix_array(x)).tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for i in order:  # previous and next smaller positions in suffix order
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else -1
        stack.append(i)

    def common(i, j, k):
        while i + k < n and data[i + k] == data[j + k]:
            k += 1
        return k

    left = right = 0
    for i in range(n):  # a match at i leaves one at i + 1 that is a byte shorter
        left = common(i, before[i], max(left - 1, 0)) if before[i] >= 0 else 0
        right = common(i, after[i], max(right - 1, 0)) if after[i] >= 0 else 0
        out[i] = max(left, right)
    return out


def later_copies(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each text, the mask of bytes covered by a ``length``-byte string that begins earlier; first copies stay."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    cut = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = _window_starts(cut, length)
    lpf = np.zeros(len(x), np.int64)
    if len(starts):
        lpf[starts] = matches_before_and_after(suffix_array(x, length)[starts], starts, length)[0]
    mask = _covered(np.flatnonzero(lpf), length, len(x))
    return [mask[cut[i] : cut[i + 1]] for i in range(len(texts))]


def _window_starts(cut: np.ndarray, length: int) -> np.ndarray:
    sizes = np.maximum(np.diff(cut) - length + 1, 0)
    return np.repeat(cut[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + length, -1)
    return np.cumsum(delta[:-1]) > 0


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(h, c, document, p, a, b) of a block: windows that begin at a..b have their minimiser at p.

    h is the k-gram's hash, c that of all bytes of these windows with the anchor's place in them.
    Positions count from the document's start.
    """
    n, wide = len(data), length - gram + 1
    starts = _window_starts(offsets, length)
    if not len(starts):
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)]
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    # The hash's upper half with the place below it: the least is the leftmost of equal halves.
    value = (h >> U(31) << U(31)) | at.astype(np.uint64)
    size = -(-(len(value) + wide) // wide) * wide
    padded = np.full(size, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[: len(value)] = value
    rows = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (np.minimum(behind[starts], ahead[starts + wide - 1]) & U(0x7FFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    a, b, p, doc = starts[first], starts[np.append(first[1:], len(starts)) - 1], p[first], doc[first]
    c = mix(span_hash(prefix, a, b + length) + (p - a).astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(7))
    base = offsets[doc]
    return h[p], c, doc, p - base, a - base, b - base


def _anchor_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of each text; a task tells of equal texts once. ``t`` names the text."""
    names = ["h", "c", "t", "p", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            t = np.asarray(batch.column(0))
            new = np.zeros(len(t), bool)
            for i, key in enumerate(t.tolist()):
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            column = batch.column(1).filter(pa.array(new))
            data, offsets = text_view(column)
            own = t[new]
            for lo, hi in chunks(offsets, 1 << 20):
                h, c, doc, p, a, b = anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(own[lo + doc]), *(pa.array(x.astype(np.int32)) for x in (p, a, b))], names=names)

    texts = documents.where(F.octet_length("text") >= length).select("t", "text")
    return texts.mapInArrow(run, "h long, c long, t long, p int, a int, b int")


def _marked(rows: DataFrame) -> DataFrame:
    """Anchors that occur again. kind 0: settled; 1: settled, and speaks for its context; 2: an edge."""
    one = Window.partitionBy("h")
    same = Window.partitionBy("h", "c")
    first = F.row_number().over(same.orderBy("t", "p"))
    marked = rows.withColumns({"n": F.count("*").over(same), "r": first})
    marked = marked.withColumns({"m": F.sum((F.col("r") == 1).cast("int")).over(one), "hot": F.sum((F.col("r") == 1).cast("int")).over(one) > HOT_CONTEXTS})
    kind = F.when(F.col("n") == 1, 2).when((F.col("m") > 1) & (F.col("r") == 1), 1).otherwise(0)
    return marked.where("n > 1 OR m > 1").select("t", "h", "p", "a", "b", kind.alias("kind"), "hot")


def _contexts(documents: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """Bytes of the contexts of edges and of those that speak for settled ones, from one document of each text."""
    wanted = marked.where("kind > 0").groupBy("t").agg(F.collect_list(F.struct("h", "a", "b", "kind", "hot")).alias("runs"))
    wanted = checkpointed(wanted.join(documents.groupBy("t").agg(F.min("doc_id").alias("doc_id")), "t"))
    kind = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("edge", pa.bool_()), ("hot", pa.bool_()), ("bytes", pa.large_binary())])

    def run(batches):
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            runs = batch.column(1)
            flat, cut = runs.flatten(), runs.offsets.to_numpy() - runs.offsets[0].as_py()
            h, a, b, k, hot = (np.asarray(flat.field(i).to_numpy(zero_copy_only=False)) for i in range(5))
            doc = np.repeat(np.arange(len(runs)), np.diff(cut))
            start = offsets[doc] + a
            stop = offsets[doc] + b + length
            step = max(1, (32 << 20) // (2 * length))
            for lo in range(0, len(h), step):
                s, e = start[lo : lo + step], stop[lo : lo + step]
                size = e - s
                bounds = np.concatenate([[0], np.cumsum(size)])
                own = data[np.repeat(s - bounds[:-1], size) + np.arange(bounds[-1])]
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(own)])
                d = doc[lo : lo + step]
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + step]), pa.array(np.asarray(batch.column(2))[d]), pa.array(a[lo : lo + step].astype(np.int32)), pa.array(k[lo : lo + step] == 2), pa.array(hot[lo : lo + step].astype(bool)), blob.cast(pa.binary())], names=kind.names)

    texts = prefiltered(documents.select("doc_id", "t", "text"), wanted, "doc_id").join(wanted, ["doc_id", "t"])
    return texts.select("text", "runs", "t").mapInArrow(run, "h long, t long, a int, edge boolean, hot boolean, bytes binary")


def matches_before_and_after(rank: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each start the longest previous factor, and its mirror towards later places, up to ``depth``: whole matches count, shorter ones as 0.

    In suffix order cut at ``depth``, the previous smaller position of a suffix
    that has a whole match before it is its neighbour of the same rank; the next
    larger one likewise tells of a match after it.
    """
    order = np.lexsort((starts, rank))
    same = rank[order][1:] == rank[order][:-1]
    before, after = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    before[order[1:][same]] = depth
    after[order[:-1][same]] = depth
    return before, after


def _repeated_windows(data: np.ndarray, cut: np.ndarray, length: int) -> np.ndarray:
    """Of every window of a block of contexts, whether it occurs again in the block, before it or after it."""
    starts = _window_starts(cut, length)
    before, after = matches_before_and_after(suffix_array(data, length)[starts], starts, length)
    return (before >= length) | (after >= length)


def _edge_runs(contexts: DataFrame, length: int) -> DataFrame:
    """(t, a, b): runs of window starts at the edges of repeats, by suffix order within each anchor."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def settle():
            t, a, edge, blobs = zip(*held)
            cut = np.concatenate([[0], np.cumsum([len(x) for x in blobs])])
            again = _repeated_windows(np.frombuffer(b"".join(blobs), np.uint8), cut, length)
            first = np.concatenate([[0], np.cumsum(np.diff(cut) - length + 1)])
            owner = np.repeat(np.arange(len(blobs)), np.diff(first))
            hit = again & np.array(edge)[owner]
            at = np.arange(len(owner)) - first[:-1][owner]
            return _runs(np.array(t, np.int64), np.array(a, np.int64), owner[hit], at[hit])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for h, t, a, edge, blob in zip(*columns):
                if h != last and size > BLOCK_BYTES:
                    yield settle()
                    held, size = [], 0
                last = h
                held.append((t, a, edge, blob))
                size += len(blob)
        if held:
            yield settle()

    cold = contexts.where("NOT hot").select("h", "t", "a", "edge", "bytes").repartition("h").sortWithinPartitions("h")
    return cold.mapInArrow(run, "t long, a int, b int")


def _runs(t: np.ndarray, a: np.ndarray, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Consecutive starts of one owner as runs."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(owner)) - 1 if len(i) else i
    o = owner[i]
    return pa.RecordBatch.from_arrays([pa.array(t[o]), pa.array((a[o] + at[i]).astype(np.int32)), pa.array((a[o] + at[j]).astype(np.int32))], names=["t", "a", "b"])


def _hot_runs(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: windows are counted by hash, so no task gathers an anchor."""

    def run(batches):
        for batch in batches:
            data, offsets = text_view(batch.column(3).cast(pa.large_binary()))
            starts = _window_starts(offsets, length)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            w = span_hash(prefix_hash(data), starts, starts + length)
            edge = np.asarray(batch.column(2).to_numpy(zero_copy_only=False))[owner]
            s = np.asarray(batch.column(1))[owner] + (starts - offsets[owner])
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.asarray(batch.column(0))[owner]), pa.array(s.astype(np.int32)), pa.array(edge)], names=["w", "t", "s", "edge"])

    windows = contexts.where("hot").select("t", "a", "edge", "bytes").mapInArrow(run, "w long, t long, s int, edge boolean")
    again = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return windows.where("edge").join(again, "w").select("t", F.col("s").alias("a"), F.col("s").alias("b"))


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t, runs): for each text with t = xxhash64(text), the runs (a, b) of starts of windows that occur again.

    Texts that occur more than once are not listed: all their windows do.
    """
    rows = _marked(_anchor_rows(documents, length, gram))
    marked = checkpointed(rows)
    release(documents.sparkSession)  # the anchors' shuffle
    contexts = _contexts(documents, marked, length)
    contexts = checkpointed(contexts) if marked.where("hot").limit(1).count() else contexts
    found = marked.where("kind < 2").select("t", "a", "b").unionByName(_edge_runs(contexts, length))
    if marked.where("hot").limit(1).count():
        found = found.unionByName(_hot_runs(contexts, length))
    return found.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    size = F.octet_length("text").cast("long")
    base = checkpointed(docs.select("doc_id", "t", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    # Texts that occur again are known by their SHA-256: the 64-bit t would delete two texts for a collision.
    copies = base.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n > 1").select("sha", "t", F.lit(True).alias("copied"))
    copies = checkpointed(copies)
    spans = checkpointed(repeated_spans(docs, length, gram).join(copies.select("t"), "t", "left_anti"))

    def run(batches):
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            removed, n_spans, sha = [], [], []
            for d, runs in enumerate(batch.column(2)):
                own = data[offsets[d] : offsets[d + 1]]
                flat = runs.values
                delta = np.zeros(len(own) + 1, np.int32)
                np.add.at(delta, np.asarray(flat.field(0)), 1)
                np.add.at(delta, np.asarray(flat.field(1)) + length, -1)
                gone = np.cumsum(delta[:-1]) > 0
                removed.append(int(gone.sum()))
                n_spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                sha.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["t", "n_removed", "n_spans", "kept"])

    cut = prefiltered(docs.select("t", "text"), spans, "t").join(spans, "t").select("t", "text", "runs").mapInArrow(run, "t long, n_removed long, n_spans long, kept string")
    all_gone = F.coalesce("copied", F.lit(False))
    return (
        base.join(copies.select("sha", "copied"), "sha", "left").join(cut, "t", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )
