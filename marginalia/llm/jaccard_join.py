"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct n-word shingles. Sets fall into size
bands such that similar sets lie in one band or in neighbours. For each pair of
bands the feature domain is partitioned: sets whose symmetric difference is at
most k differ in at most one feature in some first-level partition (there are
more than k / 2), which is split in three; a signature stands for each pair of
the three, so that similar sets share one. Signatures over no or one feature,
which unrelated sets share, are left out where spare partitions make up for them. Sets sharing a signature form
candidate families; within a family links are verified exactly.

Nothing grows with the square of a group: equal sets collapse to one node
before signatures meet, sketches part most nodes of a bucket without a row for
any pair, a set is not compared with members of its own component, and families
beyond a bound are verified in pairs of bounded blocks.

Defined results: null and empty texts have no shingles and link with nothing;
fewer than ``n`` words are one shingle; equal sets link; repeated rows belong
to one component, and several texts with one doc_id are judged each by itself;
a null doc_id comes after all others; an empty table gives an empty result;
extra columns are ignored.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow_text import SPACE_TABLE, U, chunks, mix, powers, prefix_hash, span_hash, text_view, words
from marginalia.llm.graph import components
from marginalia.session import checkpointed, dropped

#: Features (64-bit hashes) of a family, or of a block of one, that a task holds at most.
BLOCK_FEATURES = 4_000_000
#: Nodes of a bucket that are compared by sketches at once; a larger bucket becomes one family.
BUCKET_NODES = 4_096
#: Parts of the signature space that are shuffled one after the other, so that a fixed share of it is on disk.
TURNS = 2
#: Signatures that a task holds before it sends them on, and sets among these that may share one.
BLOCK_SIGNATURES = 1_000_000
HOT_NODES = 256
_K = [U(k) for k in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)]


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Last sizes of the bands: band i ends at floor(its first size / threshold)."""
    ends, first = [], 1
    while first < most:
        ends.append(first * 100 // percent)
        first = ends[-1] + 1
    return np.array(ends, np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): every n-word shingle's hash, in text order, and each document's range."""
    mapped = SPACE_TABLE
    starts, ends, first = words(data, offsets, mapped)
    word = span_hash(prefix_hash(mapped[data]), starts, ends)
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(size)])
    # Word k of a shingle, or nothing beyond a short document's end.
    begin = np.repeat(first[:-1], size) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    end = np.repeat(first[1:], size)
    code = np.zeros(bounds[-1], np.uint64)
    padded = np.append(word, np.zeros(n, np.uint64))
    _, down = powers(n + 1)
    for k in range(n):
        inside = begin + k < end
        code += np.where(inside, padded[begin + k] * _K[k % 4] * down[k // 4] + U(k + 1), U(0))
    return mix(code), bounds


def nodes_of(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 64-bit identity of each set, signed."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(features ^ _K[3]), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _K[0]).view(np.int64)


def node_of(features: np.ndarray) -> int:
    return int(nodes_of(features, np.array([0, len(features)]))[0])


def signatures_of(features: np.ndarray, bounds: np.ndarray, ends: np.ndarray, percent: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) in the set's own band's scheme and the next one's, of every ``turns``-th first-level partition from ``turn`` on.

    A signature over no feature (or over one, where signatures hold more) is weak:
    unrelated sets share it. There are ``spare`` partitions more than needed, so similar sets agree in more
    than ``spare`` of them; a set with at most ``spare`` partitions that have a
    weak signature leaves the weak ones out and still meets every similar set.
    """
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(features * _K[1] + _K[2])
    band, out = np.searchsorted(ends, sizes), []
    for scheme in (band, band + 1):
        # Symmetric difference of similar sets of at most ends[scheme] features each; if 0, only equal sets are similar, and these are one node.
        k = 2 * (100 - percent) * ends[scheme] // (100 + percent)
        fewest, spare = weakness(k // 2 + 1, percent)
        n1 = np.where((k > 0) & (sizes > 0), k // 2 + 1 + spare, 0)
        row = np.concatenate([[0], np.cumsum(n1)])
        some = n1[of] > 0
        mine, own_features = of[some], features[some]
        salt = (scheme.astype(np.uint64) + U(1)) * _K[0]
        cell = 3 * row[mine] + (mix(own_features + salt[mine]) % (3 * n1[mine]).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(3 * row[-1], np.uint64)
        np.add.at(sums, cell, spread[some])
        s, size = sums.reshape(-1, 3), np.bincount(cell, minlength=len(sums)).reshape(-1, 3)
        weak = size.sum(1, keepdims=True) - size < fewest  # column q leaves out subpartition q
        owner = np.repeat(np.arange(len(n1)), n1)
        leave = np.bincount(owner[weak.any(1)], minlength=len(n1)) <= spare
        keep = ~(weak & leave[owner][:, None])
        j = np.arange(row[-1]) - row[:-1][owner]
        now = j % turns == turn
        s, keep, owner, j = s[now], keep[now], owner[now], j[now]
        tag = j.astype(np.uint64) * U(3) * _K[1] + scheme[owner].astype(np.uint64) * _K[2]
        left, right = s[:, [1, 0, 0]], s[:, [2, 2, 1]]
        own = mix(mix(left + U(1)) * _K[0] + right * _K[3] + tag[:, None] + np.arange(3, dtype=np.uint64) * _K[1])
        # 48 bits are enough for candidates and shuffle smaller; the last one tells the scheme.
        own = own >> U(16) & ~U(1) | (scheme[owner] & 1).astype(np.uint64)[:, None]
        out.append((own[keep], np.repeat(owner, keep.sum(1))))
    return tuple(np.concatenate([x[i] for x in out]) for i in (0, 1))


def signatures(features: np.ndarray, ends: np.ndarray, percent: int, turn: int = 0, turns: int = 1) -> np.ndarray:
    """One set's signatures."""
    return signatures_of(features, np.array([0, len(features)]), ends, percent, turn, turns)[0]


def weakness(n1: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(features below which a signature is weak, partitions added so that weak ones can be left out).

    A signature of the smallest sets of a scheme holds about 2/3 p**2 (1 + p) / (1 - p)
    features; where these are few, too many would have one, and only empty ones are weak.
    """
    p = percent / 100
    if 2 / 3 * p * p * (1 + p) / (1 - p) >= 5.5:
        return 2, (n1 + 12) // 25 + (n1 >= 8)
    return 1, (n1 + 6) // 12 + (n1 >= 8)


def _sets(batch_column, n: int):
    """(first document, distinct shingle hashes of some documents in a row, bounds of each one's) over a column."""
    data, offsets = text_view(batch_column)
    for lo, hi in chunks(offsets, 1 << 20):
        code, bounds = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
        new = np.ones(len(code), bool)
        for d in range(hi - lo):
            code[bounds[d] : bounds[d + 1]].sort()
        new[1:] = code[1:] != code[:-1]
        new[bounds[:-1][np.diff(bounds) > 0]] = True
        yield lo, code[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sketches_of(features: np.ndarray, bounds: np.ndarray, ends: np.ndarray, percent: int) -> list[list[bytes]]:
    """Of each set a byte for each of about 1.5 k parts of the feature domain, in its scheme of even number and in its odd one.

    Parts with different bytes hold different features, so there are no more of
    them than features in the symmetric difference: too many prove that two sets
    are not similar.
    """
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    out, band = [[b""] * len(sizes), [b""] * len(sizes)], np.searchsorted(ends, sizes)
    for scheme in (band, band + 1):
        m = np.where(sizes > 0, sketch_size(scheme, ends, percent), 0)
        first = np.concatenate([[0], np.cumsum(m)])
        some = m[of] > 0
        mine, own = of[some], features[some]
        salt = (scheme.astype(np.uint64) + U(77)) * _K[1]
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, first[mine] + (mix(own ^ salt[mine]) % m[mine].astype(np.uint64)).astype(np.int64), own)
        told = (mix(sums) >> U(56)).astype(np.uint8).tobytes()
        for d, odd in enumerate((scheme & 1).tolist()):
            out[odd][d] = told[first[d] : first[d + 1]]
    return out


def sketch(features: np.ndarray, ends: np.ndarray, percent: int) -> list[bytes]:
    """One set's sketches."""
    return [x[0] for x in sketches_of(features, np.array([0, len(features)]), ends, percent)]


def sketch_size(scheme, ends: np.ndarray, percent: int):
    return 3 * (100 - percent) * ends[scheme] // (100 + percent)


def set_nodes(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, t (the text's hash), n_shingles, the node of its set and the set's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bands(percent)
        for batch in batches:
            for lo, features, bounds in _sets(batch.column(2), n):
                count = len(bounds) - 1
                own = [pa.array(np.diff(bounds)), pa.array(nodes_of(features, bounds)), *(pa.array(x, pa.binary()) for x in sketches_of(features, bounds, ends, percent))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, count), batch.column(1).slice(lo, count), *own], names=["doc_id", "t", "n_shingles", "node", "even", "odd"])

    return documents.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n_shingles long, node long, even binary, odd binary")


def _signature_rows(documents: DataFrame, n: int, percent: int, turn: int, turns: int) -> DataFrame:
    """(sig, node, star): the signatures of one turn; a task tells of each set once, so hot copies become a row per task.

    Where more than HOT_NODES sets of a task's block share a signature, they
    become one family there: each comes once with ``star``, its family's smallest
    node, and that node alone stands for them under the signature.
    """

    def run(batches):
        ends, seen = bands(percent), set()
        out, held = [], 0

        def flush():
            sig, node = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            star = np.zeros(len(sig), np.int64)
            own = np.zeros(len(sig), bool)
            slot = (sig >> 1) & 0xFFFF  # only slots that are full enough can hold a hot signature
            often = np.bincount(slot, minlength=1 << 16) > HOT_NODES
            at = np.flatnonzero(often[slot]) if often.any() else np.zeros(0, np.int64)
            if len(at):
                order = at[np.lexsort((node[at], sig[at]))]
                ordered = sig[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                size = np.diff(np.append(first, len(order)))
                low = np.repeat(node[order[first]], size)
                hot = np.repeat(size > HOT_NODES, size) & (node[order] != low)
                star[order[hot]], own[order[hot]] = low[hot], True
                # Of many signatures that give a node the same family one is enough.
                told = np.flatnonzero(own)
                stay = ~own
                if len(told):
                    stay[told[np.unique(np.stack([node[told], star[told]]), axis=1, return_index=True)[1]]] = True
                sig, node, star, own = sig[stay], node[stay], star[stay], own[stay]
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(star, mask=~own)], names=["sig", "node", "star"])

        for batch in batches:
            for _, features, bounds in _sets(batch.column(0), n):
                node = nodes_of(features, bounds)
                new = np.diff(bounds) > 0
                for d, key in enumerate(node.tolist()):
                    if key in seen:
                        new[d] = False
                    elif new[d]:
                        seen.add(key)
                if not new.all():
                    features, bounds = features[np.repeat(new, np.diff(bounds))], np.concatenate([[0], np.cumsum(np.diff(bounds)[new])])
                sig, own = signatures_of(features, bounds, ends, percent, turn, turns)
                out.append((sig.view(np.int64), node[new][own]))
                held += len(sig)
                if held > BLOCK_SIGNATURES:
                    yield flush()
                    out, held = [], 0
        yield flush()

    return documents.select("text").mapInArrow(run, "sig long, node long, star long")


def _buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node, parity of the scheme, star) of the different groups of two nodes or more that share a signature, and of the stars made before."""

    def run(batches):
        seen: set[int] = set()
        out, held = [], 0
        pending: list[tuple[np.ndarray, np.ndarray]] = []  # the group that may go on

        def told(sig, node):
            """Rows of complete groups; a group's name is the hash of its nodes."""
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[new], node[new]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(sig)))
            name = mix(np.add.reduceat(mix(node.view(np.uint64)), at) + size.astype(np.uint64)).view(np.int64) if len(at) else at
            keep = size > 1
            for i in np.flatnonzero(keep).tolist():
                key = int(name[i])
                if key in seen:
                    keep[i] = False
                elif len(seen) < 1_000_000:
                    seen.add(key)
            wide = np.repeat(keep, size)
            return np.repeat(name, size)[wide], node[wide], sig[wide] & 1

        def batch_of(out):
            b, n, s = (np.concatenate([o[k] for o in out]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(n), pa.array(s.astype(np.int8)), pa.nulls(len(b)).cast(pa.int64())], names=names)

        def whole():
            return tuple(np.concatenate([x[k] for x in pending]) for k in range(2))

        for batch in batches:
            made = pc.is_valid(batch.column(2))
            stars = batch.filter(made)
            if stars.num_rows:
                nothing = pa.nulls(stars.num_rows)
                yield pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), stars.column(1), nothing.cast(pa.int8()), stars.column(2)], names=names)
                batch = batch.filter(pc.invert(made))
            if not batch.num_rows:
                continue
            sig, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = int(np.searchsorted(sig, sig[-1])) if not pending or sig[0] != sig[-1] or pending[0][0][0] != sig[0] else -1
            if cut < 0:  # all of the batch goes on with the group
                pending.append((sig, node))
                continue
            pending.append((sig[:cut], node[:cut]))
            out.append(told(*whole()))
            held += len(out[-1][0])
            pending = [(sig[cut:], node[cut:])]
            if held > 100_000:
                yield batch_of(out)
                out, held = [], 0
        if pending:
            out.append(told(*whole()))
        if out:
            yield batch_of(out)

    names = ["bucket", "node", "parity", "star"]
    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "bucket long, node long, parity byte, star long")


def bucket_links(sizes: np.ndarray, sketches: list[bytes], percent: int, parity: int) -> np.ndarray:
    """Component numbers within a bucket, by pairs that the sketches do not tell apart."""
    n, ends = len(sizes), bands(percent)
    band = np.searchsorted(ends, sizes)
    scheme = int(band.max())
    scheme += (scheme ^ parity) & 1
    m = sketch_size(scheme, ends, percent)
    comp = np.arange(n)
    if scheme - int(band.min()) > 1:  # sets of one signature are of one band or of neighbours, hashes aside
        comp[:] = 0
        return comp
    rows = np.empty((n, m), np.uint8)
    for i in range(n):
        rows[i] = np.frombuffer(sketches[i], np.uint8)
    for i in range(n - 1):
        rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        both = sizes[rest] + sizes[i]
        fits = 100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])
        rest, both = rest[fits], both[fits]
        if not len(rest):
            continue
        differ = (rows[rest] != rows[i]).sum(1)
        for j in rest[differ * (100 + percent) <= (100 - percent) * both]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
    return comp


def _candidate_forest(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): within each bucket, trees of nodes that may be similar; a very large bucket is one tree."""

    def run(batches):
        last, node, size, sketches, star, parity = None, [], [], [], None, 0
        edges: list[tuple[int, int]] = []

        def settle():
            if len(node) > 1:
                comp = bucket_links(np.array(size), sketches, percent, parity) if star is None else np.zeros(len(node), np.int64)
                low = {}
                for c, v in zip(comp.tolist(), node):
                    low[c] = min(v, low.get(c, v))
                edges.extend((v, low[c]) for c, v in zip(comp.tolist(), node) if v != low[c])
            if star is not None and node:
                edges.append((node[0], star))

        for batch in batches:
            for b, v, n, s, own in zip(*(c.to_pylist() for c in batch.columns)):
                if b != last:
                    settle()
                    parity = own
                    last, node, size, sketches, star = b, [], [], [], None
                node.append(v)
                size.append(n)
                sketches.append(s)
                if len(node) >= BUCKET_NODES:
                    star = node[0] if star is None else star
                    edges.extend((v, star) for v in node)
                    node, size, sketches = [], [], []
            if len(edges) > 50_000:
                yield _pair_batch(np.unique(np.array(edges, np.int64), axis=0))
                edges.clear()
        settle()
        if edges:
            yield _pair_batch(np.unique(np.array(edges, np.int64), axis=0))

    # Only nodes of some bucket, and of each node one sketch, travel on.
    met = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    known = met.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_shingles", "even", "odd")])
    chosen = F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd")).alias("sketch")
    rows = buckets.join(known, "node").select("bucket", "node", "n_shingles", chosen, "parity")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number of each set, by all links with Jaccard of percent / 100 or more.

    Sets come in order of size. A set that is similar to a smaller one shares
    one of its rarest features (more of them than similar sets can differ in)
    with that one's rarest, so only such sets are compared, and none that is
    already in the same component.
    """
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    _, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    flat = rarity[flat]
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ids = [np.sort(flat[cut[i] : cut[i + 1]]) for i in order]
    size = np.array([len(x) for x in ids])
    mark = np.zeros(len(often) + 1, bool)
    comp, members = np.arange(n), {i: [i] for i in range(n)}
    postings: dict[int, list[int]] = {}

    def linked(i, them):
        own = np.concatenate([ids[j] for j in them])
        at = np.concatenate([[0], np.cumsum(size[them])])[:-1]
        shared = np.add.reduceat(mark[own], at, dtype=np.int64)
        return them[100 * shared >= percent * (size[i] + size[them] - shared)]

    def merge(i, j):
        a, b = comp[i], comp[j]
        if a != b:
            if len(members[a]) > len(members[b]):
                a, b = b, a
            comp[members[a]] = b
            members[b] += members.pop(a)

    for i in range(n):
        rare = ids[i][: size[i] - (percent * size[i] + 99) // 100 + 1].tolist()
        near = [postings[f] for f in rare if f in postings]
        if near:
            them = np.unique(np.concatenate([np.array(x) for x in near]))
            them = them[100 * size[them] >= percent * size[i]]
            mark[ids[i]] = True
            # The latest member of each component first: one link spares the others.
            _, last = np.unique(comp[them][::-1], return_index=True)
            first = them[len(them) - 1 - last]
            for part in [first] if len(first) == len(them) else [first, them]:
                for lo in range(0, len(part), 1024):
                    left = part[lo : lo + 1024]
                    left = left[comp[left] != comp[i]]
                    if len(left):
                        for j in linked(i, left):
                            merge(i, j)
            mark[ids[i]] = False
        for f in rare:
            postings.setdefault(f, []).append(i)
    out = np.empty(n, np.int64)
    out[order] = comp
    return out


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each (family, i, j)."""

    def run(key, table):
        nodes = table.column("node").to_numpy()
        own = [np.asarray(x.values).view(np.uint64) for x in table.column("features")]
        comp = link_sets(own, percent) if len(own) else np.zeros(0, np.int64)
        low: dict[int, int] = {}
        for c, v in zip(comp, nodes):
            low[c] = min(low.get(c, v), v)
        root = np.array([low[c] for c in comp], np.int64)
        return pa.table({"a": pa.array(nodes), "b": pa.array(root)})

    return sets.groupBy("fam", "i", "j").applyInArrow(run, "a long, b long").where("a <> b").distinct()


def components_of(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links)."""
    return _linked(documents, n, percent).select("doc_id", "n_shingles", "component_id")


def _place():
    """The order of rows: by doc_id, those without one last, and by text hash."""
    return F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "t")


def _linked(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, t, n_shingles, component_id and whether the row is its component's first by (doc_id, t)."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    nodes = checkpointed(set_nodes(docs, n, percent))
    turns = [checkpointed(_buckets(_signature_rows(docs, n, percent, k, TURNS))) for k in range(TURNS)]
    found = reduce(DataFrame.unionByName, turns)
    # A group met in two schemes is compared in one; all its nodes have met in the same ones.
    buckets = checkpointed(found.where("star IS NULL").groupBy("bucket", "node").agg(F.min("parity").alias("parity")))
    stars = found.where("star IS NOT NULL").select(F.col("node").alias("a"), F.col("star").alias("b"))
    forest = checkpointed(_candidate_forest(buckets, nodes, percent).unionByName(stars.distinct()))
    dropped(buckets, *turns)
    families = components(forest)
    dropped(forest)
    whole = nodes
    nodes = checkpointed(nodes.select("doc_id", "t", "n_shingles", "node"))
    dropped(whole)
    reps = nodes.where("n_shingles > 0").join(families, "node").groupBy("node", "n_shingles", "root").agg(F.min(_place()).alias("at"))
    reps = checkpointed(reps.select("at.doc_id", "at.t", "root", "n_shingles"))
    dropped(families)
    # Only families beyond a block are named again, so no join brings a family together.
    weight = reps.groupBy("root").agg(F.sum("n_shingles").alias("weight")).where(F.col("weight") > BLOCK_FEATURES)
    large = checkpointed(weight.select("root", F.ceil(F.col("weight") / BLOCK_FEATURES).cast("int").alias("nb")))
    split = not large.isEmpty()
    reps = reps.drop("n_shingles")
    reps = reps.join(large, "root", "left").select("doc_id", "t", "root", F.coalesce("nb", F.lit(1)).alias("nb")) if split else reps.withColumn("nb", F.lit(1))

    def load(batches):
        for batch in batches:
            for lo, features, bounds in _sets(batch.column(0), n):
                count = len(bounds) - 1
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(features.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, count), batch.column(2).slice(lo, count), pa.array(nodes_of(features, bounds)), lists], names=["fam", "nb", "node", "features"])

    mine = prefiltered(docs, reps, "t").alias("d").join(reps.alias("r"), F.expr("d.doc_id <=> r.doc_id AND d.t = r.t"))
    wanted = mine.select("text", F.col("root").alias("fam"), "nb")
    sets = wanted.mapInArrow(load, "fam long, nb int, node long, features array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    sets = sets.select("fam", "node", "features", F.explode(pairs).alias("p")).select("fam", "p.i", "p.j", "node", "features")
    links = checkpointed(_verified(sets, percent))
    dropped(large)
    # One task's forest is stars on the smallest node already; forests of block pairs are joined.
    roots = components(links) if split else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = checkpointed(nodes.join(roots, "node", "left").select("doc_id", "t", "n_shingles", F.coalesce("root", "node").alias("root")))
    dropped(nodes, links)
    several = named.where("n_shingles > 0").groupBy("root").agg(F.count("*").alias("rows"), F.min(_place()).alias("least"))
    # Written, so that a hot component's rows are split when they meet the one row here.
    least = checkpointed(several.where("rows > 1").select("root", "least"))
    judged = named.join(least, "root", "left")
    alone = F.col("least").isNull() | (F.col("n_shingles") == 0)
    first = alone | (F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.t") == F.col("t")))
    return judged.select("doc_id", "t", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), first.alias("first"))


def prefiltered(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 1 << 22) -> DataFrame:
    """``rows`` without most of those whose key is not wanted, before a join shuffles them.

    A bitmap of fixed size (half a megabyte) travels, whatever the number of keys;
    it may let others pass, so the join still follows.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    packed = wanted.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("v"))
    words_of = np.zeros(bits // 64, np.int64)
    for r in packed.toLocalIterator():
        words_of[r.w] = r.v
    shared = rows.sparkSession.sparkContext.broadcast(words_of)
    names = rows.columns

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            s = np.asarray(batch.column(len(names)))
            keep = (bitmap[s >> 6] >> (s & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep))

    return rows.withColumn("_slot", slot).mapInArrow(run, rows.schema)


#: Columns added for a while; no table has columns of these names.
TEXT_HASH, GONE_ID, GONE_HASH = "__text_hash__", "__gone_id__", "__gone_hash__"


def keep_first(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (the first by doc_id and text hash); documents without shingles all stay.

    Rows are told apart by doc_id and text, so of several texts with one doc_id
    each is judged by itself; rows that repeat both stand or fall together.
    """
    gone = _linked(documents, n, percent).where("NOT first").select(F.col("doc_id").alias(GONE_ID), F.col("t").alias(GONE_HASH)).distinct()
    rows = documents.withColumn(TEXT_HASH, F.xxhash64("text"))
    return rows.join(checkpointed(gone), F.expr(f"doc_id <=> {GONE_ID} AND {TEXT_HASH} = {GONE_HASH}"), "left_anti").drop(TEXT_HASH)
