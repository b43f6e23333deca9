"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes keeps, for every context of up to
ORDER bytes, how often each byte followed. A byte costs -log2 of its estimate
in the longest context known to the language; a byte unseen there pays the
escape probability (method C) and is coded in the next shorter context, down
to a uniform estimate over all bytes. Statistics are frozen after training, so
a text's code length is an exact sum over its bytes, and the language with the
shortest code wins. The sum is a table lookup per byte: the tables hold, for
each context node and byte, the finished cost under every language.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the language that sorts first; with nothing to learn from, all
texts are ``und``; repeated rows are each judged; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow_text import chunks, text_view

ORDER = 3
#: Documents a language is learned from at most, chosen by a hash of their id: whole ones of up to
#: TRAIN_BYTES first, and where there are too few, so many bytes each of longer ones. This bounds the sample's size.
TRAIN_DOCS = 400
TRAIN_BYTES = 20_000
SCHEMA = "doc_id long, lang_pred string, score double"


def held_out(doc_id="doc_id"):
    """The evaluation fold: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals in small letters."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def _contexts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, number of the ORDER classes before it); 0 stands before a text's start."""
    own = classes[folded(data)].astype(np.int32)
    context = np.zeros(len(own), np.int32)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(own), np.int32)
        before[back:] = own[:-back] if len(own) > back else own[:0]
        for k in range(back):  # positions less than ``back`` into their text
            at = offsets[:-1] + k
            at = at[at < offsets[1:]]
            before[at] = 0
        context += before * base ** (back - 1)
    return own, context


class ContextTrees:
    """Frozen statistics of all languages, as one table of costs by (node, byte class)."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        if not texts:
            return
        seen = np.zeros(256, bool)
        for own in texts.values():
            seen[folded(np.frombuffer(b"".join(own), np.uint8))] = True
        self.classes = np.zeros(256, np.uint8 if seen.sum() < 254 else np.uint16)
        self.classes[seen] = np.arange(1, seen.sum() + 1)
        self.classes[~seen] = seen.sum() + 1
        base = self.base = int(seen.sum()) + 2
        events = {}
        for lang in self.langs:
            data = np.frombuffer(b"".join(texts[lang]), np.uint8)
            events[lang] = _contexts(data, np.concatenate([[0], np.cumsum([len(t) for t in texts[lang]])]), self.classes, base)
        # Nodes: every context of 0..ORDER classes that any language has met. The base
        # digits of a context number are its classes, the nearest byte lowest.
        full = np.zeros(base**ORDER, np.int32)
        cost = [np.full((1, base, len(self.langs)), 8.0, np.float32)]
        parents, nodes, first = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        for order in range(ORDER + 1):
            size = base**order
            if order:
                parents, first_was = nodes, first
                nodes = np.unique(np.concatenate([events[x][1] % size for x in self.langs] or [np.zeros(0, np.int64)])).astype(np.int64)
                up = np.searchsorted(parents, nodes % base ** (order - 1))
                inherited = cost[-1][up]
            else:
                inherited, first_was = cost[0], 0
            table = inherited.copy()
            for k, lang in enumerate(self.langs):
                own, context = events[lang]
                at = np.searchsorted(nodes, context % size)
                count = np.bincount(at * base + own, minlength=len(nodes) * base).reshape(len(nodes), base).astype(np.float32)
                total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    coded = -np.log2(count / (total + kinds))
                    escaped = -np.log2(kinds / (total + kinds)) + inherited[:, :, k]
                table[:, :, k] = np.where(total == 0, inherited[:, :, k], np.where(count > 0, coded, escaped))
            if order:
                cost.append(table)
                first += len(cost[-2])
            else:
                cost[0] = table
            # A context number belongs to the longest known suffix.
            number = np.full(size, -1, np.int64)
            number[nodes] = np.arange(len(nodes)) + first
            step = np.arange(size) if order == ORDER else None
            if order == 0:
                known = number
            else:
                shorter = np.tile(known, base)
                known = np.where(number >= 0, number, shorter)
            if step is not None:
                full = known.astype(np.int32)
        self.node = full
        self.cost = np.concatenate(cost).reshape(-1, len(self.langs))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        own, context = _contexts(data, offsets, self.classes, self.base)
        row = self.node[context].astype(np.int64) * self.base + own
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if len(filled):
            for k in range(len(self.langs)):
                out[filled, k] = np.add.reduceat(self.cost[row, k], offsets[:-1][filled], dtype=np.float64)
        return out


def learn(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> ContextTrees:
    """Trees from the training fold: at most ``train_docs`` texts of each language."""
    base = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order, long = F.xxhash64(F.col("doc_id")), F.octet_length("text") > TRAIN_BYTES
    counts = base.groupBy("lang").agg(F.count_if(~long).alias("short"), F.count_if(long).alias("long")).collect()
    if not counts:
        return ContextTrees({})
    # A hash threshold per language and kind takes about 1.5 times the documents asked for; the rest is cut exactly.
    share = lambda wanted, n: min(1.0, 1.5 * wanted / n) if wanted > 0 and n else 0.0
    rates = {r.lang: (share(train_docs, r["short"]), share(train_docs - r["short"], r["long"])) for r in counts}
    rate = [F.create_map(*[F.lit(x) for lang, own in rates.items() for x in (lang, own[k])]) for k in (0, 1)]
    taken = F.when(long, F.element_at(rate[1], F.col("lang"))).otherwise(F.element_at(rate[0], F.col("lang")))
    few = base.where(F.pmod(order, F.lit(1 << 20)) < taken * (1 << 20)).select("lang", long.alias("long"), "doc_id", F.left("text", F.lit(TRAIN_BYTES)).alias("text"))
    texts: dict[str, list[tuple[bool, int, bytes]]] = {}
    for r in few.toLocalIterator():
        texts.setdefault(r.lang, []).append((r.long, r.doc_id, r.text.encode()[:TRAIN_BYTES]))
    return ContextTrees({k: [t for _, _, t in sorted(v)[:train_docs]] for k, v in texts.items()})


def predict(documents: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, lang_pred and the posterior probability of that language under equal priors."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            names, scores = [], []
            for lo, hi in chunks(offsets, 1 << 20):
                letters = batch.column(2).slice(lo, hi - lo).to_pylist()
                if not trees.langs:
                    names += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                bits = trees.lengths(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                best = bits.argmin(1)
                share = 1 / np.exp2(bits.min(1)[:, None] - bits).sum(1)
                names += [trees.langs[b] if has else "und" for b, has in zip(best, letters)]
                scores += [float(s) if has else 0.0 for s, has in zip(share, letters)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter")
    return documents.select("doc_id", "text", letter).mapInArrow(run, SCHEMA)


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the training fold and judge every document."""
    judged = predict(documents, learn(documents))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame) -> DataFrame:
    """Documents with a language, ``lang`` set to the one found; those without a letter go, and all of them if there is nothing to learn from."""
    trees = learn(documents)
    if not trees.langs:
        return documents.where(F.lit(False))
    columns = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(trees)
    kept = documents.where(F.col("text").rlike("\\p{L}"))

    def run(batches):
        trees = shared.value
        for batch in batches:
            data, offsets = text_view(batch.column("text"))
            names = []
            for lo, hi in chunks(offsets, 1 << 20):
                bits = trees.lengths(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                names += [trees.langs[b] for b in bits.argmin(1)]
            at = batch.schema.get_field_index("lang")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], names=columns)

    return kept.mapInArrow(run, documents.schema)
