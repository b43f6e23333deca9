"""Benchmark decontamination over a stored, distributed positional inverted index.

The corpus is indexed once, into a Parquet table in the shared folder: a row
for each term and slice of documents with the sorted list of the positions at
which the slice holds it. Counting that table tells the rarest term of every
benchmark window; a join on it finds the slices where the window can stand,
and the lists of such a slice are intersected, rarest first: adjusted by offset
for exact occurrences, by distance for proximity matches (stretches of at most
SPAN words of one document that hold every term of a window, in any order; an
exact occurrence is one of them). All windows of a slice go through each list
together. Terms are 64-bit hashes of words, windows hashes of their terms; only
terms of the benchmark are indexed. The driver sees counts and a bitmap of fixed size.

A frequent term has one row a slice, so no list is longer than a slice, and a
slice meets at most BLOCK_WINDOWS windows at a time: a larger benchmark is dealt
into blocks, each of which meets the slice's lists in a task of its own.

Defined results: null and empty texts have no words and no hits; an item
without words has no windows; repeated documents, and several texts with one
doc_id, are each reported; repeated items count once per row, and each item_id is listed once; an empty benchmark
leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow_text import ALNUM_TABLE, chunks, prefix_hash, span_hash, text_view, words
from marginalia.session import checkpointed, dropped, stored

WINDOW = 10
#: Words of a stretch at most that holds all terms of a window.
SPAN = 2 * WINDOW
#: Bytes of text whose postings make one list of a term (one document at least).
SLICE_BYTES = 8 << 20
#: Different windows that one task holds beside the lists of one slice.
BLOCK_WINDOWS = 1 << 19
#: Places that are intersected at a time.
PLACES = 1 << 20
#: Rows up to which a counted table of terms or windows is broadcast (about a hundred bytes each).
BROADCAST_ROWS = 100_000
#: The bitmap of benchmark terms has 2**BITS bits, whatever the number of terms.
BITS = 22
_SPANS = "array<struct<start:int,stop:int>>"
INDEX = "slice long, term long, n int, positions binary, doc int, doc_id long, t long, n_words long, first long"
FOUND = f"slice long, doc int, doc_id long, t long, n_words long, hits {_SPANS}, phrases array<long>, near_hits {_SPANS}, near_phrases array<long>"


def tokens(text: bytes) -> list[bytes]:
    """The words of one text in plain Python, for tests: A-Z lower-cased, split at ASCII bytes that are neither digit nor letter."""
    return text.translate(ALNUM_TABLE.tobytes()).split()


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the words of a block of texts, and each text's first word's number (one more entry than texts)."""
    starts, ends, first = words(data, offsets, ALNUM_TABLE)
    return span_hash(prefix_hash(ALNUM_TABLE[data]), starts, ends).view(np.int64), first


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


# ---------------------------------------------------------------- windows


def _cutter(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for lo, hi in chunks(offsets):
                h, first = _hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                count = np.diff(first)
                length = np.minimum(size, count)
                each = np.where(count > 0, count - length + 1, 0)
                item = np.repeat(np.arange(hi - lo), each)
                start = first[item] + _steps(each)
                for a in range(0, len(item), 1 << 17):
                    own = length[item[a : a + (1 << 17)]]
                    flat = h[np.repeat(start[a : a + (1 << 17)], own) + _steps(own)]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + item[a : a + (1 << 17)])), lists], names=["item_id", "terms"])

    return cut


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms, phrase) of every window of every item."""
    cut = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_cutter(window), "item_id long, terms array<long>")
    return cut.withColumn("phrase", F.xxhash64("terms"))


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which values of the upper BITS bits the terms have; 2**BITS bits travel, whatever the number of terms."""
    upper = F.shiftrightunsigned("term", 64 - BITS)
    rows = terms.groupBy(F.shiftright(upper, 15).alias("bucket")).agg(F.bitmap_construct_agg(upper.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    bits = np.zeros((1 << (BITS - 15), 1 << 12), np.uint8)
    for row in rows.collect():
        bits[row.bucket] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits.ravel()


# ---------------------------------------------------------------- index


def _indexer(shared, gap: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value, bitorder="little").astype(bool)
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for lo, hi in chunks(offsets, SLICE_BYTES):
                h, at, first, count = _placed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], known, gap)
                docs = {"doc": np.arange(hi - lo), "doc_id": batch.column(0).slice(lo, hi - lo), "t": batch.column(2).slice(lo, hi - lo), "n_words": count, "first": first}
                yield _rows(name, hi - lo, docs)
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                bounds = np.concatenate([begin, [len(h)]])
                lists = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(at.astype(np.int32))])
                yield _rows(name, len(begin), {"term": h[begin], "n": np.diff(bounds), "positions": lists})
                name += 1

    return build


def _placed(data, offsets, known, gap):
    """Hashes and positions of a slice's known words, each text's first position and number of words; ``gap`` unused positions follow each text."""
    hashes, places, firsts, counts, base = [], [], [], [], 0
    for lo, hi in chunks(offsets):
        h, first = _hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        count = np.diff(first)
        shift = base + np.arange(hi - lo) * gap
        at = np.arange(len(h)) + np.repeat(shift, count)
        keep = known[h.view(np.uint64) >> np.uint64(64 - BITS)]
        hashes.append(h[keep])
        places.append(at[keep])
        firsts.append(first[:-1] + shift)
        counts.append(count)
        base += len(h) + (hi - lo) * gap
    return (np.concatenate(x) for x in (hashes, places, firsts, counts))


_INDEX_TYPES = [("slice", pa.int64()), ("term", pa.int64()), ("n", pa.int32()), ("positions", pa.binary()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int64()), ("n_words", pa.int64()), ("first", pa.int64())]


def _rows(name: int, n: int, columns: dict) -> pa.RecordBatch:
    columns = {"slice": np.full(n, name), **columns}
    arrays = [pa.nulls(n, kind) if columns.get(c) is None else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind) for c, kind in _INDEX_TYPES]
    return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in _INDEX_TYPES])


def index_of(documents: DataFrame, terms: DataFrame, gap: int) -> DataFrame:
    """The stored index of ``documents``: rows with a term are postings lists, rows without one tell a slice's documents."""
    shared = documents.sparkSession.sparkContext.broadcast(_bitmap(terms))
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    return stored(docs.mapInArrow(_indexer(shared, gap), INDEX))


# ---------------------------------------------------------------- intersection


class PositionalIndex:
    """The lists of one slice. ``keys`` holds (term's rank, position) of every posting, sorted, in one number each."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        order = np.argsort(terms)
        self.terms = terms[order]
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        self.keys = np.sort((np.repeat(rank, counts) << 32) + positions)
        self.bounds = np.concatenate([[0], np.cumsum(counts[order])])

    def ranks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of a matrix of terms, and the rows all of whose terms have a list."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(len(terms), bool)
        rank = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return rank, (self.terms[rank] == terms).all(axis=1)

    def _after(self, rank, at):
        """Words from ``at`` to the term's next position (0: there), very many if there is none."""
        key = (rank << 32) + at
        k = np.searchsorted(self.keys, key)
        return np.where(k < len(self.keys), self.keys[np.minimum(k, len(self.keys) - 1)] - key, 1 << 40), key, k

    def near(self, ranks: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of each row's first term with every other term at most ``far`` words away."""
        count = np.diff(self.bounds)[ranks[:, 0]]
        row = np.repeat(np.arange(len(ranks)), count)
        at = self.keys[self.bounds[ranks[row, 0]] + _steps(count)] & 0xFFFFFFFF
        for k in range(1, ranks.shape[1]):
            after, key, place = self._after(ranks[row, k], at)
            # A key of another term is at least 2**31 away.
            before = np.where(place > 0, key - self.keys[np.maximum(place - 1, 0)], 1 << 40)
            kept = np.minimum(after, before) <= far
            row, at = row[kept], at[kept]
        return row, at

    def exact(self, ranks, offsets, row, at) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of exact occurrences: every list, adjusted by its offset, holds the start."""
        start = at - offsets[row, 0]
        row, start = row[start >= 0], start[start >= 0]
        for k in range(1, ranks.shape[1]):
            kept = self._after(ranks[row, k], start + offsets[row, k])[0] == 0
            row, start = row[kept], start[kept]
        return row, start

    def stretches(self, ranks, row, at, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, stop) of the stretches of at most ``span`` words that begin at a term and hold every term, from places of the first term."""
        pairs = np.unique(((row << 32) + at)[:, None] - np.arange(span))
        row, begin = pairs >> 32, pairs & 0xFFFFFFFF
        inside = (begin < 1 << 31) & (row >= 0)  # beginnings before the slice borrow from the row
        row, begin = row[inside], begin[inside]
        at_term, last = np.zeros(len(row), bool), np.zeros(len(row), np.int64)
        for k in range(ranks.shape[1]):
            after = self._after(ranks[row, k], begin)[0]
            at_term |= after == 0
            last = np.maximum(last, after)
        kept = at_term & (last < span)
        return row[kept], begin[kept], (begin + last + 1)[kept]


def _parts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PLACES places, one row at least."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PLACES, side="right")))
        yield lo, hi
        lo = hi


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists without nulls."""
    return pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy()


def _matcher(window: int, span: int):
    def match(lists: pa.Table, probes: pa.Table) -> pa.Table:
        docs = lists.filter(pc.is_null(lists["term"])).sort_by("doc")
        lists = lists.filter(pc.is_valid(lists["term"]))
        first = docs["first"].to_numpy()
        n = len(docs)
        deltas = np.zeros((2, (int(first[-1] + docs["n_words"][-1].as_py()) if n else 0) + 1), np.int32)
        pairs: tuple[list, list] = ([], [])
        if len(lists) and len(probes):
            positions = np.frombuffer(b"".join(lists["positions"].to_pylist()), np.int32).astype(np.int64)
            index = PositionalIndex(lists["term"].to_numpy(), lists["n"].to_numpy(), positions)
            flat, length = _flat(probes["terms"])
            # Rows of fewer terms repeat their last one, which changes no intersection.
            cell = (np.cumsum(length) - length)[:, None] + np.minimum(np.arange(window), length[:, None] - 1)
            ranks, whole = index.ranks(flat[cell])
            ranks, offsets = ranks[whole], _flat(probes["offsets"])[0].astype(np.int64)[cell[whole]]
            phrases, length = probes["phrase"].to_numpy()[whole], length[whole]
            for lo, hi in _parts(np.diff(index.bounds)[ranks[:, 0]]):
                part = ranks[lo:hi]
                row, at = index.near(part, max(window, span) - 1)
                exact, start = index.exact(part, offsets[lo:hi], row, at)
                for k, (row, start, stop) in enumerate(((exact, start, start + length[lo + exact]), index.stretches(part, row, at, span))):
                    np.add.at(deltas[k], start, 1)
                    np.add.at(deltas[k], stop, -1)
                    pairs[k].append(np.unique(np.stack([np.searchsorted(first, start, side="right") - 1, phrases[lo + row]]), axis=1))
        columns = [docs[c] for c in ("slice", "doc", "doc_id", "t", "n_words")]
        for delta, found in zip(deltas, pairs):
            spans, own = _merged(delta, first), {}
            for doc, phrase in np.concatenate(found, axis=1).T.tolist() if found else ():
                own.setdefault(doc, []).append(phrase)
            columns.append(pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))))
            columns.append(pa.array([own.get(d, []) for d in range(n)], pa.list_(pa.int64())))
        return pa.table(columns, names=["slice", "doc", "doc_id", "t", "n_words", "hits", "phrases", "near_hits", "near_phrases"])

    return match


def _merged(delta: np.ndarray, first: np.ndarray) -> dict[int, list[dict]]:
    """Each document's covered stretches, from the steps up and down at their ends."""
    hit = np.cumsum(delta[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    doc = np.searchsorted(first, starts, side="right") - 1
    spans: dict[int, list[dict]] = {}
    for d, a, b in zip(doc, starts - first[doc], stops - first[doc]):
        spans.setdefault(int(d), []).append({"start": int(a), "stop": int(b)})
    return spans


def _small(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, to be broadcast if it is counted small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _matched(documents: DataFrame, windows: DataFrame, window: int, span: int) -> DataFrame:
    """A checkpoint of each document's hits and the windows that they are of."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    index = index_of(documents, terms, max(window, span))
    lists = index.where("term IS NOT NULL")
    counts = checkpointed(lists.groupBy("term").agg(F.sum("n").alias("df")))
    each = windows.dropDuplicates(["phrase"]).select("phrase", F.posexplode("terms").alias("offset", "term"))
    each = each.join(_small(counts), "term", "left")
    rows = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("df", "term", "offset"))).alias("order"))
    # A window with a term that the corpus lacks stands nowhere.
    rows = checkpointed(rows.where(~F.exists("order", lambda x: x["df"].isNull())).select("phrase", F.col("order.term").alias("terms"), F.col("order.offset").alias("offsets")))
    blocks = max(1, -(-rows.count() // BLOCK_WINDOWS))
    rarest = rows.select(F.element_at("terms", 1).alias("term"), F.pmod("phrase", F.lit(blocks)).cast("int").alias("at_block"), "phrase", "terms", "offsets")
    probes = lists.select("term", F.col("slice").alias("at_slice")).join(F.broadcast(rarest) if blocks == 1 and rows.count() <= BROADCAST_ROWS else rarest, "term").drop("term")
    dealt = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.groupBy("slice", "block").cogroup(probes.groupBy("at_slice", "at_block")).applyInArrow(_matcher(window, span), FOUND)
    if blocks > 1:
        fold = [_union(F.flatten(F.collect_list(p + "hits"))).alias(p + "hits") for p in ("", "near_")]
        fold += [F.flatten(F.collect_list(p + "phrases")).alias(p + "phrases") for p in ("", "near_")]
        found = found.groupBy("slice", "doc").agg(*[F.first(c).alias(c) for c in ("doc_id", "t", "n_words")], *fold)
    found = checkpointed(found)
    dropped(index, counts, rows)
    return found


def _union(spans):
    """Spans that touch or overlap made one, in order."""

    def add(done, h):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], h["stop"]).alias("stop"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= h["start"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(h)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """Per document: n_words, merged hit spans in words, the contaminating item_ids, and near_hits and near_item_ids of proximity matches."""
    windows = checkpointed(windows_of(benchmark, window))
    found = _matched(documents, windows, window, span)
    owners = windows.select("phrase", "item_id").where("item_id IS NOT NULL").distinct()
    for p in ("", "near_"):
        own = found.select("slice", "doc", F.explode(p + "phrases").alias("phrase")).join(owners, "phrase")
        own = own.groupBy("slice", "doc").agg(F.array_sort(F.collect_set("item_id")).alias(p + "item_ids"))
        found = found.join(own, ["slice", "doc"], "left").withColumn(p + "item_ids", F.coalesce(p + "item_ids", F.array().cast("array<long>")))
    return found.select("doc_id", "n_words", "hits", "item_ids", "near_hits", "near_item_ids")


def _covered(hits):
    """Words inside the union of spans (sorted sweep)."""
    sweep = F.aggregate(
        F.array_sort(hits),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, h: F.struct(
            (a["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(h["start"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], h["stop"]).alias("reach"),
        ),
    )
    return sweep["n"].cast("long")


def report(overlaps: DataFrame) -> DataFrame:
    """The digest columns of ``find_overlaps``, of exact windows."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    hit = _covered(F.col("hits"))
    return overlaps.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


#: Columns added for a while; no table has columns of these names.
TEXT_HASH, BAD_ID, BAD_HASH = "__text_hash__", "__bad_id__", "__bad_hash__"


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, most_share: float = 0.0) -> DataFrame:
    """Documents whose share of hit words is at most ``most_share``; columns as given.

    Marks travel by doc_id and the text's hash, so of several texts with one doc_id only marked ones go.
    """
    windows = checkpointed(windows_of(benchmark))
    found = _matched(documents, windows, WINDOW, SPAN)
    bad = found.where((F.size("hits") > 0) & (_covered(F.col("hits")) > F.lit(most_share) * F.col("n_words")))
    bad = checkpointed(bad.select(F.col("doc_id").alias(BAD_ID), F.col("t").alias(BAD_HASH)).distinct())
    dropped(found, windows)
    rows = documents.withColumn(TEXT_HASH, F.xxhash64("text"))
    return rows.join(bad, F.expr(f"doc_id <=> {BAD_ID} AND {TEXT_HASH} = {BAD_HASH}"), "left_anti").drop(TEXT_HASH)


def digest_of(item_ids) -> str:
    """items_sha256 in plain Python, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()
