"""SentencePiece encoding and decoding that keeps the way back to source bytes.

Every text is normalised by longest-prefix matches in the model's compiled
character map (a double-array trie), recording for every normalised byte the
source byte it came from. The normalised text falls into chunks at which no
piece of the vocabulary can merge (a run of meta spaces and what follows);
the library's own merge engine, its normaliser switched off, encodes each
distinct chunk once, and each piece of the text is projected back to a span of
original bytes.

Defined results: a null text counts as empty and gives only the begin and end
ids; repeated rows are each encoded; a text of any length is one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.arrow_text import chunks, text_view

META = "▁"
META_BYTES = META.encode()
#: A normaliser spec (field 3 of a model, merged over the model's own) that leaves a text as it is.
AS_IT_IS = b"\x1a\x08" + b"\x12\x00" + b"\x18\x00" + b"\x20\x00" + b"\x28\x00"
#: Distinct chunks that a worker remembers before it starts anew.
REMEMBERED = 200_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long, spans_sha256 string"


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""

    def varint(i):
        value = shift = 0
        while True:
            byte = blob[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(blob):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            if kind == 2:
                size, i = varint(i)
            else:
                size = 8 if kind == 1 else 4
            value, i = blob[i : i + size], i + size
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, then its replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.targets = blob[4 + size :]
        #: Of each byte whether an entry can begin with it: the trie's first step.
        self.begins = np.array([self._begins(x) for x in range(256)], bool)

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        root = self.units[0]
        node = ((root >> 10) << ((root & 512) >> 6)) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, i: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest entry that begins at i."""
        units = self.units
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, best = step(units[0]), None
        for k in range(i, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                best = k + 1 - i, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.targets[best[1] : self.targets.index(0, best[1])]


def covered(spans: np.ndarray) -> int:
    """Source bytes that the spans cover."""
    return int((spans[:, 1] - spans[:, 0]).sum())


class Codec:
    """One model: normaliser, chunked encoder with spans, decoder."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model + AS_IT_IS)
        norm, self.own_symbols, crossing = {}, False, False
        self.dummy = self.strip = self.escape = True
        for number, value in _fields(model):
            if number == 3:
                norm = dict(_fields(value))
            elif number == 1:
                piece = dict(_fields(value))
                crossing |= META in piece[1].decode().lstrip(META)
                self.own_symbols |= piece.get(3) == 4
        self.map = CharacterMap(norm.get(2, b""))
        self.dummy, self.strip, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        #: Normalised chunks are independent unless a piece spans them; decoded ones unless spaces are stripped.
        self.chunked = self.dummy and self.escape and not (self.strip or crossing or self.own_symbols)
        self.bos, self.eos, self.unknown = self.engine.bos_id(), self.engine.eos_id(), self.engine.unk_id()
        self.sizes = np.array([1 if self.engine.is_byte(i) else len(self.engine.id_to_piece(i).encode()) for i in range(self.engine.vocab_size())], np.int64)
        self.cache: dict[bytes, tuple[bytes, str]] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source byte of each and of the end), by longest prefixes."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        count = np.arange(len(raw) + 1, dtype=np.int32)
        parts, at, after_space = [], 0, True
        for i in np.flatnonzero(self.map.begins[data] | (data == 32) if self.strip else self.map.begins[data]).tolist():
            hit = self.map.longest(raw, i) if i >= at else None
            if i < at or hit is None and not (self.strip and raw[i] == 32):
                continue
            if i > at:
                parts.append((data[at:i], count[at:i]))
                after_space = False
            size, put = hit or (1, b" ")
            if self.strip and after_space:
                put = put.lstrip(b" ")
            if put:
                parts.append((np.frombuffer(put, np.uint8), np.full(len(put), i, np.int32)))
                after_space = put.endswith(b" ")
            at = i + size
        if at < len(raw):
            parts.append((data[at:], count[at:-1]))
        if not parts:
            return b"", count[-1:]
        if self.dummy:
            parts.insert(0, (np.array([32], np.uint8), parts[0][1][:1]))
        put, source = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        out = put.tobytes()
        if self.escape:
            out, source = out.replace(b" ", META_BYTES), np.repeat(source, np.where(put == 32, len(META_BYTES), 1))
        if self.strip:
            tail, end = META_BYTES if self.escape else b" ", len(out)
            while out.endswith(tail, 0, end):
                end -= len(tail)
            # The text ends for its pieces where the stripped spaces begin.
            return out[:end], np.append(source, count[-1:])[: end + 1]
        return out, np.append(source, count[-1:])

    def _chunks(self, normal: bytes) -> list[bytes]:
        """The normalised text cut before each run of meta spaces, each chunk without its first one."""
        parts = normal[len(META_BYTES) :].split(META_BYTES)
        if b"" not in parts:
            return parts
        out, run = [], b""
        for part in parts[:-1]:
            if part:
                out.append(run + part)
                run = b""
            else:
                run += META_BYTES
        return [*out, run + parts[-1]]

    def _learn(self, chunks: list[bytes]) -> None:
        """Remember of each chunk its ids and its decoded text."""
        found = self.merges.encode([META + c.decode() for c in chunks], num_threads=1)
        plain = self.engine.decode(found, num_threads=1)
        self.cache.update((c, (np.array(ids, "<u4").tobytes(), text)) for c, ids, text in zip(chunks, found, plain))

    def encode_aligned(self, texts: list[str | None]) -> list[tuple[bytes, str, np.ndarray]]:
        """(ids as little-endian 32-bit integers, decoded text, source span of each piece between begin and end) of each text."""
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        normal = [self.normalise(t or "") for t in texts]
        cut = [self._chunks(n) if n and self.chunked else [] for n, _ in normal]
        wanted = {c for parts in cut for c in parts}
        unseen = wanted - self.cache.keys()
        if unseen:
            if len(unseen) + len(self.cache) > REMEMBERED:
                self.cache.clear()
                unseen = wanted
            self._learn(list(unseen))
        known, out = self.cache, []
        for text, (n, source), parts in zip(texts, normal, cut):
            if self.chunked:
                got = [known[c] for c in parts]
                raw, plain = b"".join([g[0] for g in got]), " ".join([g[1] for g in got])
            else:
                # Symbols of the model's own are matched before its map; the library's normaliser sees to them.
                ids = self.engine.encode(text or "") if self.own_symbols else self.merges.encode(n.decode())
                raw, plain = np.array(ids, "<u4").tobytes(), self.engine.decode(ids)
            out.append((begin + raw + end, plain, self._project(n, source, np.frombuffer(raw, "<u4"))))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str, int]]:
        """(ids as little-endian 32-bit integers, decoded text, source bytes covered by the pieces' spans) of each text."""
        return [(raw, plain, covered(spans)) for raw, plain, spans in self.encode_aligned(texts)]

    def encode(self, text: str | None) -> tuple[bytes, str, int]:
        return self.encode_batch([text])[0]

    def _project(self, normal: bytes, source: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows of (first byte, end byte) in the source, one for each id of a whole text."""
        sizes = self.sizes[ids]
        for k in np.flatnonzero(ids == self.unknown).tolist():
            # An unknown piece is one character.
            lead = normal[int(sizes[:k].sum())]
            sizes[k] = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        edges = source[np.minimum(bounds, len(normal))]
        return np.stack([edges[:-1], edges[1:]], axis=1)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(first byte, end byte, id) in the source of each piece of a whole text."""
        raw, _, spans = self.encode_aligned([text])[0]
        return [(a, b, i) for (a, b), i in zip(spans.tolist(), np.frombuffer(raw, "<u4")[1:-1].tolist())]

    def decode(self, ids: list[int]) -> str:
        return self.engine.decode(ids)


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """Per document: token count, digests of ids and decoded text, source bytes covered by pieces, and a digest of the pieces' spans.

    That of the spans is SHA-256 over (first byte, end byte) of each piece, as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in batches:
            n, ids, decoded, span_bytes, span_digests = [], [], [], [], []
            _, offsets = text_view(batch.column(1))
            for lo, hi in chunks(offsets, 1 << 20):
                for raw, plain, spans in codec.encode_aligned(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(plain.encode()).hexdigest())
                    span_bytes.append(covered(spans))
                    span_digests.append(hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(span_bytes, pa.int64()), pa.array(span_digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes", "spans_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encode_spans(documents: DataFrame, model_path: str) -> DataFrame:
    """Per document the pieces' ids with their spans of original bytes."""

    def run(batches):
        codec = Codec(model_path)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("id", pa.int32())]))
        for batch in batches:
            rows = [[dict(zip(("start", "stop", "id"), s)) for s in codec.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "pieces"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, pieces array<struct<start:int,stop:int,id:int>>")
