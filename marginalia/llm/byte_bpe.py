"""Byte-level BPE through a lazily determinised finite-state transducer, and a streaming decoder.

The merges are compiled into a trie of the tokens' bytes and, for each token,
the two parts of its last merge. Two tokens may stand side by side when no
merge across their border comes before the merges that complete them; of all
ways to cut a byte string into tokens exactly one has only such borders, and
it is what the merges give. So a non-deterministic transducer guesses where
tokens end and checks each border. It is determinised as bytes arrive: a state
is the set of its live guesses, each a place in the trie, the token before it
and the tokens that it has not yet emitted. What all guesses agree on is
emitted, so no token waits for more bytes than the longest token has. A step
that was taken once is looked up from then on.

Decoding looks up each token in a table of (bytes of an unfinished character,
token), filled as needed by a UTF-8 state machine that reads one byte at a time.

Defined results: a null text counts as empty and has no ids; repeated rows are
each encoded; a text, and a match of the pattern, of any length is encoded
whole; special tokens are ordinary text; bytes that are no UTF-8 decode to
U+FFFD, one for each maximal part.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.arrow_text import chunks, text_view

#: Steps, and distinct matches of up to SHORT characters, that a worker remembers before it starts anew.
STEPS, REMEMBERED, SHORT = 600_000, 300_000, 64
#: Characters of a text whose matches are listed at once; those of a longer text are listed in blocks of BLOCK.
LISTED, BLOCK = 1 << 20, 1 << 16
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """A vocabulary by rank, its trie, and the parts of each token's last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        if not all(bytes([x]) in ranks for x in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.ranks, self.bytes = ranks, {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens that merges cannot make: they stand for themselves only as a whole match.
        self.orphans: dict[bytes, int] = {}
        self.step: dict[int, int] = {}
        self.ends, self.inner = [-1], {0}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) != 2:
                    self.orphans[token] = rank
                    continue
                self.parts[rank] = ranks[parts[0]], ranks[parts[1]]
            node = 0
            for byte in token:
                self.inner.add(node)
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.step[key]
            self.ends[node] = rank
        self._borders: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._adjoin: dict[int, bool] = {}

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """What the merges of ranks under ``below`` leave of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token, its outermost part on one side, that one's, ..., each with the rank of the merge that ends it."""
        found = self._borders.get((token, side))
        if found is None:
            found, end, part = [], float("inf"), token
            while True:
                found.append((part, end))
                if part not in self.parts:
                    break
                part, end = self.parts[part][side], part
            self._borders[token, side] = found
        return found

    def adjoin(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: no merge across the border is due before one of its sides is merged inwards."""
        known = self._adjoin.get(left << 32 | right)
        if known is None:
            known = self._adjoin[left << 32 | right] = self._can_adjoin(left, right)
            if len(self._adjoin) > STEPS:
                self._adjoin.clear()
        return known

    def _can_adjoin(self, left: int, right: int) -> bool:
        a, b = self._border(left, 1), self._border(right, 0)
        i = j = 0
        while True:
            (p, p_ends), (q, q_ends) = a[i], b[j]
            across = self.ranks.get(self.bytes[p] + self.bytes[q])
            # Of merges of one rank the leftmost comes first.
            if across is not None and across < p_ends and across <= q_ends:
                return False
            # Undo the later of the two sides' last merges.
            if j + 1 < len(b) and (i + 1 == len(a) or q >= p):
                j += 1
            elif i + 1 < len(a):
                i += 1
            else:
                return True


class Transducer:
    """The determinised transducer of a vocabulary, built step by step as texts need it."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        #: A guess is (place in the trie, token before it or -1, tokens not yet emitted).
        self.states: dict[tuple, int] = {((0, -1, ()),): 0}
        self.guesses: list[tuple] = [((0, -1, ()),)]
        self.taken: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _take(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The step from a state over a byte: the next state, and the tokens it emits."""
        m = self.merges
        places, ends, inner = m.step, m.ends, m.inner
        live, whole, shortest = [], None, 1 << 30
        for node, before, waiting in self.guesses[state]:
            node = places.get(node << 8 | byte)
            if node is None:
                continue
            token = ends[node]
            if whole is None and token >= 0 and (before < 0 or m.adjoin(before, token)):
                whole = 0, token, (*waiting, token)
            if node in inner:
                live.append((node, before, waiting))
                shortest = min(shortest, len(waiting))
        live.append(whole)  # some token always ends here, as single bytes are tokens
        agreed, emitted = 0, ()
        if shortest:
            first = live[0][2]
            most = min(shortest, len(whole[2]))
            while agreed < most and all(g[2][agreed] == first[agreed] for g in live):
                agreed += 1
            if agreed:
                emitted = first[:agreed]
                live = [(node, before, waiting[agreed:]) for node, before, waiting in live]
        after = tuple(live)
        to = self.states.get(after)
        if to is None:
            to = self.states[after] = len(self.guesses)
            self.guesses.append(after)
        step = self.taken[state << 8 | byte] = to, emitted
        return step

    def start(self) -> Encoding:
        return Encoding(self)

    def encode(self, data: bytes) -> list[int]:
        run = self.start()
        return run.feed(data) + run.finish()


class Encoding:
    """One run of the transducer over a byte string that may come in pieces."""

    def __init__(self, machine: Transducer):
        self.machine, self.state = machine, 0

    def feed(self, data: bytes) -> list[int]:
        """The tokens that these bytes settle."""
        machine, state, out = self.machine, self.state, []
        taken = machine.taken
        for byte in data:
            step = taken.get(state << 8 | byte)
            if step is None:
                if len(taken) >= STEPS:
                    held = machine.guesses[state]
                    machine._forget()
                    taken = machine.taken
                    if held not in machine.states:
                        machine.states[held] = len(machine.guesses)
                        machine.guesses.append(held)
                    state = machine.states[held]
                step = machine._take(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        self.state = state
        return out

    def finish(self) -> list[int]:
        """The tokens still waiting, now that the string ends."""
        waiting = self.machine.guesses[self.state][-1][2]
        self.state = 0
        return list(waiting)


#: Of each lead byte of a longer character: bytes that follow, and the range of the first of them (Unicode, table 3-7).
FOLLOWING = (
    {x: (1, 0x80, 0xBF) for x in range(0xC2, 0xE0)} | {x: (2, 0x80, 0xBF) for x in range(0xE1, 0xF0)} | {x: (3, 0x80, 0xBF) for x in range(0xF1, 0xF4)}
    | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
)


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, str]:
    """One step of the UTF-8 machine: the unfinished character after the byte, and the text that is settled."""
    if not pending:
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes([byte]), "") if byte in FOLLOWING else (b"", "�")
    more, low, high = FOLLOWING[pending[0]]
    if len(pending) > 1:
        low, high = 0x80, 0xBF
    if not low <= byte <= high:
        after, text = utf8_step(b"", byte)
        return after, "�" + text
    pending += bytes([byte])
    return (b"", pending.decode()) if len(pending) > more else (pending, "")


class Decoding:
    """A streaming decoder: text comes out as soon as its characters are whole."""

    def __init__(self, tokens: dict[int, bytes], whole: dict | None = None, steps: dict | None = None):
        #: Tokens of whole characters with their text, and (unfinished character, token) -> (unfinished character, text); may be shared, as both are the same for every text.
        self.tokens, self.whole, self.steps, self.pending = tokens, {} if whole is None else whole, {} if steps is None else steps, b""

    def feed(self, ids: list[int]) -> str:
        whole = self.whole
        if not self.pending:
            try:
                return "".join([whole[x] for x in ids])
            except KeyError:
                pass
        pending, out = self.pending, []
        for token in ids:
            text = None if pending else whole.get(token)
            if text is None:
                pending, text = self._step(pending, token)
            out.append(text)
        self.pending = pending
        return "".join(out)

    def _step(self, pending: bytes, token: int) -> tuple[bytes, str]:
        step = self.steps.get((pending, token))
        if step is None:
            after, text = pending, []
            for byte in self.tokens[token]:
                after, settled = utf8_step(after, byte)
                text.append(settled)
            step = after, "".join(text)
            if not pending and not after:
                self.whole[token] = step[1]
            elif len(self.steps) < STEPS:
                self.steps[pending, token] = step
        return step

    def finish(self) -> str:
        left, self.pending = self.pending, b""
        return "�" if left else ""


class Codec:
    """A vocabulary with its pattern: encoder of texts, decoder of ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(read_ranks(path))
        self.machine = Transducer(self.merges)
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, tuple[int, ...]] = {}
        self.decoded: tuple[dict, dict] = {}, {}
        self.decimal = {rank: str(rank) for rank in self.merges.bytes}

    def _match(self, match: str) -> tuple[int, ...]:
        data = match.encode()
        whole = self.merges.orphans.get(data)
        ids = (whole,) if whole is not None else tuple(self.machine.encode(data))
        if len(match) <= SHORT:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[match] = ids
        return ids

    def encode_blocks(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a whole text, in blocks whose size is bounded but for matches that are longer."""
        if not text:
            return
        if len(text) <= LISTED:
            blocks = [self.pattern.findall(text)]
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            blocks = iter(lambda: list(islice(found, BLOCK)), [])
        known = self.seen
        for block in blocks:
            yield list(chain.from_iterable([known.get(x) or self._match(x) for x in block]))

    def encode(self, text: str | None) -> list[int]:
        return [x for block in self.encode_blocks(text) for x in block]

    def decoder(self) -> Decoding:
        return Decoding(self.merges.bytes, *self.decoded)

    def decode(self, ids: Iterable[int]) -> str:
        run = self.decoder()
        return run.feed(list(ids)) + run.finish()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """A worker compiles a vocabulary once and keeps it from task to task."""
    return Codec(path, pattern)


@contextmanager
def uncollected():
    """No cycle collection meanwhile: states and steps hold no cycles, and looking through them takes a third of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document its ids: doc_id, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            _, offsets = text_view(batch.column(1))
            for lo, hi in chunks(offsets):
                with uncollected():
                    ids = [own.encode(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``encode`` its text: doc_id, text. Null ids give a null text; an id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of its decimal ids joined by commas and of the text that they decode to.

    Each block of ids is decoded as it leaves the encoder, so a text's ids are never all held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = own.decimal
        for batch in batches:
            _, offsets = text_view(batch.column(1))
            for lo, hi in chunks(offsets):
                rows = []
                with uncollected():
                    for text in batch.column(1).slice(lo, hi - lo):
                        n, ids, plain, back = 0, hashlib.sha256(), hashlib.sha256(), own.decoder()
                        for block in own.encode_blocks(text.as_py()):
                            ids.update((("," if n else "") + ",".join([decimal[x] for x in block])).encode())
                            plain.update(back.feed(block).encode())
                            n += len(block)
                        plain.update(back.finish().encode())
                        rows.append((n, ids.hexdigest(), plain.hexdigest()))
                n, ids, plain = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, DIGESTS)
