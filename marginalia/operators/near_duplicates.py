"""Exact near-duplicate pairs over shingle sets, groups of equal sets, and the gate that keeps the first of near copies in order.

A text's set is the sorted 64-bit hashes of its shingles; sets are told apart by
SHA-256 over them, here and in ``equal_sets``. Sets meet by a positional prefix
filter: of each set the features that a similar set cannot all lack, rarest
first, are posted, and two sets that share one are compared unless their sizes
or the places of the feature rule it out. Shared postings are counted, and pairs
with fewer than similar sets share are left out. Pairs are listed for each
feature that a few sets post; of features that many sets post they are counted
in blocks of sets, so near copies by the thousand are listed once a pair and
not once for each feature. Pairs are verified in blocks of sets, so a set travels
once for each pair of blocks and not once for each pair.

Defined results: null and empty texts and texts under ``SHINGLE`` words have an
empty set, which is similar to nothing; equal sets are one group, named by its
smallest id, and are not paired; ids must be unique; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.quality import DUPLICATE, SHINGLE, shingle_source
from marginalia.session import checkpointed, dropped, release, stored

#: Odd multipliers of the hashes of words and of shingles.
WORD_BASE, SHINGLE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
IN_WORD = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))
#: Bytes of text that are hashed at once; a longer text is hashed by itself.
AT_ONCE = 1 << 20
#: Features of a block of sets, on average.
BLOCK_FEATURES = 1 << 17
#: Pairs of a pair of blocks that one group verifies, about.
PAIRS_AT_ONCE = 1 << 18
#: Sets that the order of features is taken from, and features that it ranks. Any order gives the same pairs.
ORDER_SETS, RANKED = 20_000, 1 << 17
#: Postings of a feature beyond which its sets meet in blocks; sets of a block, and counts of two blocks that are held at once.
LONG, BLOCK_SETS, CELLS = 64, 1 << 11, 1 << 23
#: Parts in which postings are shuffled, and features of the sets for which there is one more.
TURNS, TURN_FEATURES = 4, 1 << 25
#: Tasks that pairs of blocks are dealt to, at most.
TASKS = 1_000
#: Bits of a map of ids.
MAP_BITS = 1 << 24


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _set_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's shingles as sorted distinct 64-bit hashes. Texts lie between the offsets."""
    none = [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    at = np.flatnonzero(inside)  # the words' bytes
    starts = np.flatnonzero(begins[at])  # of each word its first place in ``at``
    if len(starts) < size:
        return none
    lengths = np.diff(starts, append=len(at))
    powers = np.full(int(lengths.max()), WORD_BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    letters = (data[at].astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(at)) - np.repeat(starts, lengths)]
    words = _mixed(np.add.reduceat(letters, starts))
    count = len(words) - size + 1
    hashes = words[:count].copy()
    for k in range(1, size):
        hashes = hashes * SHINGLE_BASE + words[k : k + count]
    hashes = _mixed(hashes)
    first = np.searchsorted(at[starts], offsets).tolist()
    spans = zip(first, (x - size + 1 for x in first[1:]))
    return [np.unique(hashes[lo:hi]) if hi > lo else none[0] for lo, hi in spans]


def _sets(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """The sets of about a megabyte of texts at a time."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + AT_ONCE, side="right")) - 1)
        yield _set_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        lo = hi


def _sets_of(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The sets of texts, or of lists of hashes in any order, of about a megabyte at a time."""
    if not pa.types.is_list(column.type):
        yield from _sets(column, SHINGLE)
        return
    offsets, lo = column.offsets.to_numpy(), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + AT_ONCE // 8, side="right")) - 1)
        yield [np.unique(x.values.to_numpy().view(np.uint64)) if x.is_valid else np.zeros(0, np.uint64) for x in column.slice(lo, hi - lo)]
        lo = hi


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.sha256(hashes.tobytes()).digest()


def set_keys(texts: pa.Array, size: int = SHINGLE) -> pa.Array:
    """Of each text a digest of its set of ``size``-word shingles, words being runs of a-z0-9; null without any. A null text is empty."""
    return pa.array([_digest(x) if len(x) else None for part in _sets(texts, size) for x in part], pa.binary())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _named(df: DataFrame, ident: str, text: str, carried: Sequence[str] = ()) -> DataFrame:
    return df.select(F.col(ident).alias("id"), shingle_source(F.col(text)).alias("source"), *carried)


def fingerprints(df: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SHINGLE, carried: Sequence[str] = ()) -> DataFrame:
    """(id, prints) and the columns carried along: of each text its set, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _sets(batch.column(1), size):
                own = [batch.column(k).slice(at, len(part)) for k in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([own[0], _lists(part), *own[1:]], names=["id", "prints", *carried])
                at += len(part)

    rows = _named(df, ident, text, carried)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"id {kinds['id']}", "prints array<long>", *(f"`{c}` {kinds[c]}" for c in carried)]))


def equal_sets(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, group): each id whose text has shingles, with the smallest id of those that have the same set.

    Texts are read once, and only ids and digests are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), set_keys(batch.column(1))], names=["id", "key"])

    rows = _named(df, ident, text)
    keyed = checkpointed(rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key binary").where("key IS NOT NULL"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("group")), "key").select("id", "group")


def _sampled(df: DataFrame, ident: str) -> DataFrame:
    """About ORDER_SETS rows, chosen by a hash of the id. No limit, which would bring them all into one task."""
    rate = min(1.0, ORDER_SETS / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64(ident), F.lit(1 << 20)) < rate * (1 << 20))


def _order(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features that are common in a bounded sample of the sets, sorted, and how often they are."""
    often = sample.select(F.explode("prints").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(RANKED).toArrow()
    h, n = often.column("h").to_numpy(), often.column("count").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _prefixes(sets: list[np.ndarray], order: tuple[np.ndarray, np.ndarray], percent: int) -> list[np.ndarray]:
    """The rarest features of each set: as many as a similar set cannot all lack."""
    ranked, counts = order
    out = []
    for own in sets:
        own = own.view(np.int64)
        if len(ranked) and len(own):
            at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
            own = own[np.argsort(np.where(ranked[at] == own, counts[at], 0), kind="stable")]
        out.append(own[: len(own) + (-percent * len(own) // 100) + 1].view(np.uint64))
    return out


def _keyed(rows: DataFrame, order: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(id, key, n, least, prefix) of the sets that are not empty: digest, size, least feature and first features. ``rows``: id with prints or source."""
    held = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _sets_of(batch.column(1)):
                some = np.flatnonzero([len(x) for x in part])
                sets = [part[i] for i in some]
                least = np.array([x[0] for x in sets], np.uint64).view(np.int64)
                columns = [pa.array([_digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(least), _lists(_prefixes(sets, held.value, percent))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + at)), *columns], names=["id", "key", "n", "least", "prefix"])
                at += len(part)

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key binary, n int, least long, prefix array<long>")


def _perhaps(ids: DataFrame) -> Column:
    """Whether the row's id may be among ``ids``: a map of ``MAP_BITS`` bits travels, however many they are, and never says no to one of them."""
    slot = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    rows = ids.groupBy(F.shiftright(slot, 15).alias("bucket")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    bits = np.zeros((max(1, MAP_BITS >> 15), 1 << 12), np.uint8)
    for row in rows.collect():
        bits[row.bucket] = np.frombuffer(bytes(row.bits), np.uint8)
    held = ids.sparkSession.sparkContext.broadcast(bits.ravel())

    def among(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return F.arrow_udf(among, "boolean")(slot)


def _kept(n: Column, percent: int) -> Column:
    """How many features a set of n posts."""
    return n - F.ceil(n * percent / 100) + 1


def _posted(heads: DataFrame, percent: int) -> DataFrame:
    """(h, group, size, place) of the features that each set posts."""
    each = heads.select("group", F.col("n").alias("size"), _kept(F.col("n"), percent).alias("kept"), F.posexplode("prefix").alias("place", "h"))
    return each.where("place < kept").select("h", "group", "size", "place")


def _repeated(heads: DataFrame, percent: int, total: int) -> list[DataFrame]:
    """(h, group, size, place, df) of the postings whose feature ``df`` > 1 sets post, most features being of one set alone.

    Postings are shuffled once, in up to ``TURNS`` parts by feature, each of which goes before the next.
    """
    turns = min(TURNS, 1 + total // TURN_FEATURES)
    posted, out = _posted(heads, percent), []
    for k in range(turns):
        part = posted.where(F.pmod(F.xxhash64("h"), F.lit(turns)) == k) if turns > 1 else posted
        counted = part.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
        out.append(stored(counted))
        release(heads.sparkSession)
    return out


def _need(both: Column, more: Column, percent: int) -> Column:
    """The least number of postings that similar sets share, ``both`` being the sum of their sizes and ``more`` the larger one.

    In the order of features, what two sets share beyond their postings comes after all
    postings of one of them, so it is no more than that one has left.
    """
    return (F.ceil(both * percent / (100 + percent)) - (more - _kept(more, percent))).cast("int")


def _met(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b, c, first, need), a < b: groups whose sizes allow similarity, a row for each posting that they share.

    ``c`` is 1; ``first`` is whether the places allow similarity, were it the first that they share.
    """
    a, b = posted.alias("a"), posted.alias("b")
    less, more, both = F.least("a.size", "b.size"), F.greatest("a.size", "b.size"), F.col("a.size") + F.col("b.size")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.group") < F.col("b.group")) & (less * 100 >= more * percent))
    most = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    return pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), F.lit(1).alias("c"), (most * (100 + percent) >= both * percent).alias("first"), _need(both, more, percent).alias("need"))


def _counted(rows: pa.Table, percent: int) -> pa.Table:
    """(a, b, c, size_a, size_b): of two blocks' postings of common features the pairs that share some, once each, with the number of those shared.

    ``rows``: group, h, size, side (true in the second block; a block by itself has no second).
    """
    h = rows.column("h").to_numpy()
    side = rows.column("side").to_numpy(zero_copy_only=False).astype(bool)
    names = rows.column("group").combine_chunks().dictionary_encode()
    number, names = names.indices.to_numpy(), names.dictionary
    sizes = np.zeros(len(names), np.int64)
    sizes[number] = rows.column("size").to_numpy()
    alone = not side.any()
    # Places of the sets in the counts: those of the first block are rows, those of the second columns.
    of_rows, of_columns = np.unique(number[~side]), np.unique(number if alone else number[side])
    by = np.argsort(h, kind="stable")
    edges = np.flatnonzero(np.diff(h[by], prepend=h[by[0]] - 1 if len(by) else 0)).tolist() + [len(by)]
    features = [(own[~side[own]], own if alone else own[side[own]]) for own in (by[lo:hi] for lo, hi in zip(edges, edges[1:]))]
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, CELLS // max(1, len(of_columns)))
    row, column = np.searchsorted(of_rows, number), np.searchsorted(of_columns, number)
    for lo in range(0, len(of_rows), step):
        shape = (min(step, len(of_rows) - lo), len(of_columns))
        count, dense = np.zeros(shape, np.float32), []
        for first, second in features:
            first = first[(row[first] >= lo) & (row[first] < lo + step)]
            if len(first) * len(second) * 256 >= shape[0] * shape[1]:
                dense.append((row[first] - lo, column[second]))
            elif len(first) and len(second):
                count[np.ix_(row[first] - lo, column[second])] += 1
        for k in range(0, len(dense), 512):  # what most sets have is counted as a product of matrices
            part = dense[k : k + 512]
            x, y = np.zeros((shape[0], len(part)), np.float32), np.zeros((len(part), shape[1]), np.float32)
            for j, (first, second) in enumerate(part):
                x[first, j] = y[j, second] = 1
            count += x @ y
        x, y = np.nonzero(count)
        a, b = of_rows[x + lo], of_columns[y]
        less, more = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        good = less * 100 >= more * percent
        if alone:
            good &= a < b
        found.append((a[good], b[good], count[x, y][good].astype(np.int32)))
    a, b, count = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    columns = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(count, pa.int32()), pa.array(sizes[a], pa.int32()), pa.array(sizes[b], pa.int32())]
    return pa.table(columns, names=["a", "b", "c", "size_a", "size_b"])


def _met_often(posted: DataFrame, percent: int, ident: str) -> tuple[DataFrame, list[DataFrame]]:
    """``_met`` of features that many sets post, with a row for each pair of groups, ``c`` being how many of them they share; what is to be dropped after it.

    Near copies by the thousand share all of their features, which would list each pair
    a hundred times. Sets are put into blocks of like ones, and the postings of a
    feature go once to each two blocks that have it, where pairs are counted in memory.
    ``first`` is true, as enough counted postings leave hardly a pair that places rule out.
    """
    sets = checkpointed(posted.groupBy("group").agg(F.min("h").alias("least"), F.count("*").alias("n")))
    rows, postings = sets.agg(F.count("*"), F.sum("n")).first()
    blocks = max(1, -(-rows // BLOCK_SETS), -(-postings // BLOCK_FEATURES))
    placed = checkpointed(sets.select("group", "least").repartitionByRange(blocks, "least", "group").select("group", F.spark_partition_id().alias("block")))
    where = checkpointed(posted.join(placed, "group").select("h", "group", "size", "block"))
    others = where.select("h", F.col("block").alias("other")).distinct()
    p, q = F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")
    dealt = where.join(others, "h").select(p, q, "group", "h", "size", (F.col("block") > F.col("other")).alias("side"))
    dealt = dealt.repartition(min(TASKS, blocks * (blocks + 1) // 2), "p", "q")  # few bytes and much work: not to be put into one task
    counted = dealt.groupBy("p", "q").applyInArrow(lambda rows: _counted(rows, percent), f"a {ident}, b {ident}, c int, size_a int, size_b int")
    need = _need(F.col("size_a") + F.col("size_b"), F.greatest("size_a", "size_b"), percent)
    return counted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c", F.lit(True).alias("first"), need.alias("need")), [sets, placed, where]


def _candidates(heads: DataFrame, percent: int, ident: str) -> DataFrame:
    """(a, b), a < b: every pair of groups that may be similar, once."""
    total = heads.agg(F.sum("n").alias("n")).first()["n"] or 0
    held = _repeated(heads, percent, total)
    posted = reduce(DataFrame.unionByName, held)
    often = posted.where(F.col("df") > LONG)
    met = _met(posted.where(F.col("df") <= LONG), percent)
    if not often.isEmpty():
        more, also = _met_often(often, percent, ident)
        met, held = met.unionByName(more), [*held, *also]
    enough = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("first").alias("first"), F.max("need").alias("need")).where("first AND c >= need")
    out = checkpointed(enough.select("a", "b"))
    dropped(*held)
    return out


def _verified(met: DataFrame, place: DataFrame, sets: DataFrame, percent: int, ident: str) -> DataFrame:
    """(a, b, shared, union) of the pairs that are similar; each set goes once to each pair of blocks that it has a pair in.

    ``sets``: id with prints, or with the source that they are made of, which is smaller.
    """
    dealt = met.join(place.select(F.col("group").alias("a"), F.col("block").alias("p")), "a").join(place.select(F.col("group").alias("b"), F.col("block").alias("q")), "b")
    whole = checkpointed(dealt.select("p", "q", "a", "b"))
    # Copies by the thousand have their pairs in few blocks, so these are parted by their first set.
    many = whole.groupBy("p", "q").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = checkpointed(whole.join(many, ["p", "q"], "left").select("p", "q", part, "a", "b"))
    dropped(whole)
    wanted = dealt.select("p", "q", "part", F.col("a").alias("id")).unionByName(dealt.select("p", "q", "part", F.col("b").alias("id"))).distinct()
    made = sets.columns[1]
    sets = sets.where(_perhaps(wanted.select("id")))  # most sets have no pair and are not shuffled
    held = wanted.join(sets, "id").select(F.col("p").alias("p_of"), F.col("q").alias("q_of"), F.col("part").alias("part_of"), F.col("id").alias("group"), made)

    def verify(pairs: pa.Table, arrays: pa.Table) -> pa.Table:
        names = arrays.column("group").combine_chunks()
        column = arrays.column(made).combine_chunks()
        if made == "source":
            column = _lists([x for part in _sets(column, SHINGLE) for x in part])
        flat, bounds = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
        a, b = (pc.index_in(pairs.column(c).combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        sizes = np.diff(bounds)
        shared = np.zeros(len(a), np.int64)
        edges = np.flatnonzero(np.diff(a, prepend=-1)).tolist() + [len(a)]
        for lo, hi in zip(edges, edges[1:]):
            own = np.sort(flat[bounds[a[lo]] : bounds[a[lo] + 1]])
            others = np.concatenate([flat[bounds[j] : bounds[j + 1]] for j in b[lo:hi]])
            found = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            starts = np.cumsum(sizes[b[lo:hi]]) - sizes[b[lo:hi]]
            shared[lo:hi] = np.add.reduceat(found.astype(np.int64), starts)
        union = sizes[a] + sizes[b] - shared
        good = np.flatnonzero(shared * 100 >= union * percent)
        return pa.table({"a": names.take(pa.array(a[good])), "b": names.take(pa.array(b[good])), "shared": pa.array(shared[good]), "union": pa.array(union[good])})

    tasks = min(TASKS, max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // PAIRS_AT_ONCE)))
    pairs, held = dealt.repartition(tasks, "p", "q", "part"), held.repartition(tasks, "p_of", "q_of", "part_of")
    out = pairs.groupBy("p", "q", "part").cogroup(held.groupBy("p_of", "q_of", "part_of")).applyInArrow(verify, f"a {ident}, b {ident}, shared long, union long")
    out = checkpointed(out)
    dropped(dealt)
    return out


def similar_groups(prints: DataFrame, percent: int = int(DUPLICATE * 100), sample: DataFrame | None = None, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` (id, group) names each id's group of equal sets; ``pairs`` (a, b, shared, union) are groups of Jaccard percent / 100 or more.

    ``prints``: id, prints (distinct, in any order). It is run three times, as
    whole sets take more room than the texts that they are made of: for the order
    of features, for keys and prefixes, and for the sets that are to be verified.
    ``sample`` (prints of some of the rows) stands in for it the first time, and
    ``source`` (id, source) the others, so that sets stay in the task that makes them. Equal sets are one group, so copies are never
    paired with one another. Empty sets have no group. Both results are checkpoints.
    """
    sample = _sampled(prints, "id") if sample is None else sample
    rows = prints.select("id", "prints") if source is None else source
    keyed = stored(_keyed(rows, _order(sample), percent))
    ident = dict(keyed.dtypes)["id"]
    who = checkpointed(keyed.join(keyed.groupBy("key").agg(F.min("id").alias("group")), "key").select("id", "group"))
    copies = who.where("id <> group").select("id")
    perhaps = _perhaps(copies)
    first = keyed.where(~perhaps).unionByName(keyed.where(perhaps).join(copies, "id", "left_anti"))  # one of each group; others are not shuffled
    heads = stored(first.select(F.col("id").alias("group"), "n", "least", "prefix"))
    dropped(keyed)
    release(heads.sparkSession)
    met = _candidates(heads, percent, ident)
    # Sets with the same least feature are likely to be similar, so blocks are cut from their order by it.
    total = heads.agg(F.sum("n").alias("n")).first()["n"] or 0
    ordered = heads.select("group", "least").repartitionByRange(max(1, -(-total // BLOCK_FEATURES)), "least", "group")
    place = checkpointed(ordered.select("group", F.spark_partition_id().alias("block")))
    dropped(heads)
    pairs = _verified(met, place, rows, percent, ident)
    dropped(met, place)
    return who, pairs


def text_groups(df: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = int(DUPLICATE * 100)) -> tuple[DataFrame, DataFrame]:
    """``similar_groups`` of texts."""
    return similar_groups(fingerprints(df, ident, text), percent, fingerprints(_sampled(df, ident), ident, text), _named(df, ident, text))


def gate(candidates: DataFrame, percent: int = int(DUPLICATE * 100)) -> DataFrame:
    """``gated`` of candidates with id, prints and junk."""
    return gated(similar_groups(candidates.select("id", "prints"), percent), candidates.select("id", "junk"))


def gated(groups: tuple[DataFrame, DataFrame], flags: DataFrame) -> DataFrame:
    """(id, disposition, named) in the order of ids: accepted, junk, or duplicate of the first accepted similar one.

    ``groups``: what ``similar_groups`` gives, which goes; ``flags``: id, junk. Only accepted documents hold others back.
    The accepted ones are the independent set that goes by smallest ids, found
    by rounds: of the documents that still wait, one without an earlier one that
    waits is accepted, and those similar to it go. A round carries on only the
    links between documents that wait, so there are as many rounds as the longest
    run of decisions that hang on one another, and each reads less than the last.
    Of a group of equal sets the first that is not junk speaks for it. The result is a checkpoint.
    """
    flags = checkpointed(flags.select("id", "junk"))
    who, pairs = groups
    named = checkpointed(who.join(flags, "id"))
    speaker = checkpointed(named.where("NOT junk").groupBy("group").agg(F.min("id").alias("speaker")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(speaker.select(F.col("group").alias("a"), F.col("speaker").alias("first")), "a").join(speaker.select(F.col("group").alias("b"), F.col("speaker").alias("later")), "b")
    links = checkpointed(links.where("first < later").select("first", "later"))
    gone: list[DataFrame] = []
    waiting = links
    while not waiting.isEmpty():
        later = waiting.select(F.col("later").alias("first")).distinct()
        free = checkpointed(waiting.select("first").distinct().join(later, "first", "left_anti"))  # no earlier one waits: accepted
        held = checkpointed(waiting.join(free, "first", "left_semi").select(F.col("later").alias("first")).distinct())
        settled = free.unionByName(held)
        rest = waiting.join(settled, "first", "left_anti").join(held.select(F.col("first").alias("later")), "later", "left_anti")
        rest = checkpointed(rest.select("first", "later"))
        gone.append(held)
        dropped(free, *([waiting] if waiting is not links else []))
        waiting = rest
    accepted = speaker
    if gone:
        refused = gone[0]
        for more in gone[1:]:
            refused = refused.unionByName(more)
        accepted = speaker.join(refused.select(F.col("first").alias("speaker")), "speaker", "left_anti")
    # Which accepted document each group meets first: its own speaker, or one of a similar group.
    own = accepted.select("group", F.col("speaker").alias("acc"))
    near = both.join(own.select(F.col("group").alias("a"), "acc"), "a").select(F.col("b").alias("group"), "acc")
    held_by = named.join(own.unionByName(near), "group").where("acc < id").groupBy("id").agg(F.min("acc").alias("named"))
    out = flags.join(held_by, "id", "left")
    disposition = F.when(F.col("named").isNotNull(), "duplicate").when(F.col("junk"), "junk").otherwise("accepted")
    out = checkpointed(out.select("id", disposition.alias("disposition"), "named"))
    dropped(flags, who, pairs, named, speaker, links, *([waiting] if waiting is not links else []), *gone)
    return out
