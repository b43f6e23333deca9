"""What language identification learns from: long documents, and nothing."""

import zlib

from pyspark.sql import functions as F

from marginalia.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def test_a_language_of_long_documents_is_learned(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    english, spanish = "the ships went out with the morning tide and the wind ", "los barcos salieron con la marea de la mañana y el viento "
    rows = [(i, english * 620, "en") for i in ids[:9]] + [(i, spanish, "es") for i in ids[9:18]] + [(900, english, None), (901, spanish * 900, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert min(len(r[1].encode()) for r in rows[:9]) > language_id.TRAIN_BYTES
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}
    assert got == {i: "en" for i in [*ids[:9], 900]} | {i: "es" for i in [*ids[9:18], 901]}


def test_long_documents_are_only_learned_from_where_short_ones_are_few(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "short words here", "xx") for i in ids[:10]] + [(i, "q" * 30_000, "xx") for i in ids[10:20]]
    trees = language_id.learn(spark.createDataFrame(rows, SCHEMA), train_docs=5)
    assert trees.classes[ord("q")] == trees.classes[0]  # not one of the letters that were met
    more = language_id.learn(spark.createDataFrame(rows, SCHEMA), train_docs=15)
    assert more.classes[ord("q")] != more.classes[0]


def test_without_labels_nothing_has_a_language(spark):
    df = spark.createDataFrame([(i, "some words", None) for i in range(6)], SCHEMA)
    assert {r.lang_pred for r in language_id.identify(df).collect()} == {"und"}
    kept = language_id.keep_identified(df.withColumn("h", F.lit(1)))
    assert kept.count() == 0 and kept.columns == [*df.columns, "h"]
