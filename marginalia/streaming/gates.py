"""Incremental forms: first-wins harvest of rows by id, near-duplicate gate, progress, recovery, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import near_duplicates
from marginalia.operators.sinks import snapshot
from marginalia.streaming import stateful


def harvested(rows: DataFrame, keys: list[str], time: str, patience: str = "10 minutes") -> DataFrame:
    """Each key once, as repeated scans of a list deliver it; state lives for ``patience`` of event time."""
    return rows.withWatermark(time, patience).dropDuplicatesWithinWatermark(keys)


def gated(stream: DataFrame, path: str, junk: Callable[[DataFrame], DataFrame], checkpoint: str, ident: str = "doc_id", text: str = "text", run: str | None = None):
    """A started query that appends each batch's verdicts to ``path`` (Parquet).

    What earlier batches accepted is keyed state of each run, so a batch reads of
    it only what shares features with its own documents; ids must grow from batch
    to batch, as arrival does. Without ``run`` all documents are one run, which one task judges.
    """
    rows = junk(stream).select(F.col(ident), F.col(text), (F.lit("") if run is None else F.col(run)).alias("run"), "junk")
    judged = stateful.gated(near_duplicates.fingerprints(rows, ident, text, carried=("run", "junk")))
    return judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def progress(entries: DataFrame, tell: Callable[[DataFrame], None], checkpoint: str, every: str = "250 milliseconds"):
    """A started query that hands a snapshot of each batch of entries to ``tell``, at most every so often."""
    return entries.writeStream.foreachBatch(lambda batch, _: tell(snapshot(batch))).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def recovered_phase(phase: Column) -> Column:
    """The phase of a run that was interrupted: what was under way ended, what was over stays."""
    return F.when(phase.isin("discovering", "fetching", "assembling"), "interrupted").otherwise(phase)


def retained(results: DataFrame, now: Column, minutes: int = 10, most: int = 5 * 1024 * 1024) -> DataFrame:
    """Finished results young and small enough to be kept."""
    age = F.unix_timestamp(now) - F.unix_timestamp("finished_at")
    return results.where((age <= minutes * 60) & (F.octet_length("document") <= most))
