"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import ball_tree, byte_bpe, decontamination, fill_in_middle, jaccard_join, language_id, license_scan, line_dedup, multi_index, oracles, quality_classifier, sentencepiece_codec, suffix_dedup, url_filter

#: The tokenizer files that production encodes with.
MODEL = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def ranks_path_and_pattern() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


def op1_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"), min_chars=1)


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op3_multi_index(spark, sf_dir):
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark, sf_dir):
    return decontamination.report(decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), model_path())


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.components_of(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark, sf_dir):
    return byte_bpe.digest(table(spark, sf_dir, "documents"), *ranks_path_and_pattern())


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), fill_in_middle.DIGESTS)


def op13_ball_tree(spark, sf_dir):
    return ball_tree.report(*ball_tree.cluster(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": oracles.license_scan(),
        "op4_decontamination": oracles.DECONTAMINATION,
        "op6_jaccard_join": oracles.JACCARD_JOIN,
        "op12_fill_in_middle": oracles.FILL_IN_MIDDLE,
        "op13_ball_tree": oracles.centroids(),
    }
