"""Streams whose decisions hang on what came before, as keyed state: the near-duplicate gate of a run, and the harvest of a list with its stop rules.

State is kept by the state store (RocksDB) and survives restarts with the
query's checkpoint; a batch reads of it only what its own rows need. The rows
that one key has in one batch are put in order by one task, so a source of many
files is best read with ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.operators.quality import DUPLICATE

VERDICTS = "run string, id long, disposition string, named long"
#: ``number`` is the pass, whose own name is a word of the language that rows become objects of.
HARVEST = "list string, key string, pos long, number long, ended string"
#: Features of a run's accepted sets that are kept as one value, of 8 bytes each.
RECENT = 1 << 18


def with_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Gate(StatefulProcessor):
    """The gate of one run: sets of accepted documents, and of each feature that they post the documents that do.

    Up to ``RECENT`` features of accepted sets are one value, read and written
    once a batch; beyond that they move to maps by id and by feature, of which a
    batch reads what its own rows need.
    """

    def __init__(self, percent: int, recent: int):
        self.percent, self.most = percent, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "ids binary, ends binary, prints binary, moved boolean")
        self.sets = handle.getMapState("sets", "id long", "prints binary")
        self.posted = handle.getMapState("posted", "h long", "ids binary")

    def _prefix(self, own: np.ndarray) -> list[int]:
        """As many features, in one order for all sets, as a similar set cannot all lack."""
        return own[: len(own) + (-self.percent * len(own) // 100) + 1].tolist()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value = self.recent.get()
        moved = value is not None and value[3]  # whether the maps hold anything
        recent: dict[int, np.ndarray] = {}
        postings: dict[int, list[int]] = {}
        held: dict[int, np.ndarray] = {}  # sets in the maps that were asked for
        older: dict[int, list[int]] = {}  # postings in the maps that were asked for

        def accept(ident: int, own: np.ndarray) -> None:
            recent[ident] = own
            for h in self._prefix(own):
                postings.setdefault(h, []).append(ident)

        def moved_posting(h: int) -> list[int]:
            if h not in older:
                older[h] = np.frombuffer(self.posted.getValue((h,))[0], np.int64).tolist() if self.posted.containsKey((h,)) else []
            return older[h]

        def kept(ident: int) -> np.ndarray:
            if ident in recent:
                return recent[ident]
            if ident not in held:
                held[ident] = np.frombuffer(self.sets.getValue((ident,))[0], np.int64)
            return held[ident]

        if value is not None:
            ids, ends, prints = (np.frombuffer(x, np.int64) for x in value[:3])
            for ident, own in zip(ids.tolist(), np.split(prints, ends[:-1])):
                accept(ident, own)
        before = len(recent)
        batch = pd.concat(list(rows), ignore_index=True).sort_values("id", kind="stable")
        out = []
        for ident, prints, junk in zip(batch["id"].tolist(), batch["prints"], batch["junk"].tolist()):
            own = np.unique(np.array(prints, np.int64)) if prints is not None else np.zeros(0, np.int64)
            prefix = self._prefix(own) if len(own) else []
            near = {x for h in prefix for x in postings.get(h, ())}
            if moved:
                near.update(x for h in prefix for x in moved_posting(h))
            named = None
            for other in sorted(near):
                theirs = kept(other)
                if min(len(own), len(theirs)) * 100 < max(len(own), len(theirs)) * self.percent:
                    continue
                shared = len(np.intersect1d(own, theirs, assume_unique=True))
                if shared * 100 >= (len(own) + len(theirs) - shared) * self.percent:
                    named = other
                    break
            if named is not None:
                disposition = "duplicate"
            elif junk:
                disposition = "junk"
            else:
                disposition = "accepted"
                if len(own) and ident not in recent and ident not in held:
                    accept(ident, own)
            out.append((str(key[0]), ident, disposition, named))
        if sum(map(len, recent.values())) > self.most:
            for ident, own in recent.items():
                self.sets.updateValue((ident,), (own.tobytes(),))
            for h, ids in sorted(postings.items()):
                self.posted.updateValue((h,), (np.array((moved_posting(h) if moved else []) + ids, np.int64).tobytes(),))
            self.recent.update((b"", b"", b"", True))
        elif len(recent) > before:
            ends = np.cumsum([len(x) for x in recent.values()], dtype=np.int64)
            self.recent.update((np.array(list(recent), np.int64).tobytes(), ends.tobytes(), np.concatenate(list(recent.values())).tobytes(), moved))
        frame = pd.DataFrame(out, columns=["run", "id", "disposition", "named"])
        frame["named"] = frame["named"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def gated(stream: DataFrame, percent: int = int(DUPLICATE * 100)) -> DataFrame:
    """Verdicts (run, id, disposition, named) on a stream of run, id, prints and junk.

    A document is a duplicate of the first accepted one of its run that it is
    similar to, junk if it is flagged, accepted otherwise; only accepted ones hold
    others back. A run's documents must arrive in the order of their ids, though
    not within a batch. Defined results: empty or null prints are similar to
    nothing; a null flag is none; a null run is a run of its own.
    """
    with_state_store(stream.sparkSession)
    rows = stream.select(F.coalesce(F.col("run").cast("string"), F.lit("")).alias("run"), F.col("id").cast("long").alias("id"), "prints", F.coalesce("junk", F.lit(False)).alias("junk"))
    return rows.groupBy("run").transformWithStateInPandas(_Gate(percent, RECENT), VERDICTS, "Append", "None")


class _Harvest(StatefulProcessor):
    """One list: keys seen, and (items, pass under way, items added in it, idle passes, first time, how it ended, first pass)."""

    def __init__(self, limit: int, idle: int, seconds: float, timed: bool):
        self.limit, self.idle, self.budget, self.timed = limit, idle, int(seconds * 1000), timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "key string", "pos long")
        self.state = handle.getValueState("state", "n long, pass long, added long, idle long, start long, ended string, first long")

    def _end(self, state: list, why: str) -> None:
        """The list takes nothing more, so its keys need not be kept."""
        state[5] = why
        self.seen.clear()
        for timer in list(self.handle.listTimers()) if self.timed else ():
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["number", "seq"], kind="stable")
        state = list(self.state.get()) if self.state.exists() else None
        known: set[str] = set()
        out = []
        for number, item, at in zip(batch["number"].tolist(), batch["key"], batch["ts"]):
            now = int(at.timestamp() * 1000)
            if state is None:
                state = [0, number, 0, 0, now, "", number]
                if self.timed:
                    self.handle.registerTimer(now + self.budget)
            if state[5]:
                break
            if number > state[1]:
                # The pass under way is over, and passes without rows brought nothing; the first one is no scroll and is never idle.
                quiet = state[2] == 0 and state[1] != state[6]
                state[3] = (state[3] + 1 if quiet else 0) + (number - state[1] - 1)
                state[1], state[2] = number, 0
                if self.idle and state[3] >= self.idle:
                    self._end(state, "idle")
                elif self.budget > 0 and now > state[4] + self.budget:
                    self._end(state, "deadline")
                if state[5]:
                    out.append((str(key[0]), None, None, number, state[5]))
                    break
            if not item or item in known or self.seen.containsKey((item,)):
                continue
            known.add(item)
            state[0], state[2] = state[0] + 1, state[2] + 1
            self.seen.updateValue((item,), (state[0],))
            out.append((str(key[0]), item, state[0], state[1], None))
            if self.limit and state[0] >= self.limit:
                self._end(state, "limit")
                out.append((str(key[0]), None, None, state[1], "limit"))
                break
        self.state.update(tuple(state))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = list(self.state.get())
            if not state[5]:
                self._end(state, "overdue")
                self.state.update(tuple(state))
                yield self._frame([(str(key[0]), None, None, state[1], "overdue")])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["list", "key", "pos", "number", "ended"])
        frame["pos"] = frame["pos"].astype("Int64")
        return frame

    def close(self) -> None:
        pass


def harvested(stream: DataFrame, limit: int = 0, idle: int = 3, seconds: float = 0, patience: str | None = "10 minutes") -> DataFrame:
    """Items of lists as repeated passes over them bring them, each key once, until a rule ends the list.

    ``stream``: list, pass, seq, key and ts. Rows out are items (key, pos) and, once
    a list ends, one row with ``ended``: limit (so many items are in), idle (so many
    passes on end brought nothing new; the first pass is the look at what is there
    and does not count), deadline (a pass began more than so many seconds after the
    first row) or overdue (no pass came until then, by the
    watermark, which a ``patience`` of None does without). A limit, idle
    or seconds of 0 is no rule. Passes without rows are idle ones. Defined results:
    rows without a key are no items; a row of an earlier pass than the one under way
    counts in the latter, and rows later than ``patience`` are dropped; repeated rows
    add nothing; after its end a list stays ended; a null list is a list of its own.
    """
    with_state_store(stream.sparkSession)
    rows = stream.select(F.coalesce(F.col("list").cast("string"), F.lit("")).alias("list"), F.col("pass").cast("long").alias("number"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), "ts")
    timed = seconds > 0 and patience is not None
    rows = rows.withWatermark("ts", patience) if timed else rows
    return rows.groupBy("list").transformWithStateInPandas(_Harvest(limit, idle, seconds, timed), HARVEST, "Append", "EventTime" if timed else "None").withColumnRenamed("number", "pass")


def run_to_end(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The rows of a streaming result over all that its sources hold now, written to ``path`` (Parquet, each once) and read again."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)
