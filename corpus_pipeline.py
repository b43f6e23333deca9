"""The corpus pipeline: STAGES applied to documents, each on all that its predecessor kept.

Language ID drops documents without a language, line dedup cuts repeated and
nearly repeated lines (and documents of which nothing is left), the Jaccard
join keeps one document of each group of near copies, decontamination drops
documents that hold benchmark windows, and the last stage encodes what remains.

Defined results: rows are told apart by doc_id and text, so of several texts
with one doc_id each is judged by itself, and rows that repeat both stand or
fall together; documents without text or letters go with the first stage, for
they have no language; an empty table, or nothing left after a stage, gives an
empty result; extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontamination, jaccard_join, language_id, line_dedup, sentencepiece_codec
from marginalia.llm.queries import model_path, table
from marginalia.session import dropped, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` is the one found. Learns from the training fold of ``docs``."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, or nearly stand, earlier; emptied documents go."""
    return line_dedup.remove_lines(docs, min_chars=1)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_first(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that remain."""
    return sentencepiece_codec.encode_documents(docs, model_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL can express neither the language model nor the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written as Parquet and read as the next one's input; a stage's input goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if k:
            dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
