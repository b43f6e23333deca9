"""Unique names against a plain fold; archives written, read, pruned and rolled back."""

from __future__ import annotations

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators.names import running_total, unique_names
from marginalia.sources import archives


def folded(titles):
    """The names of one batch by the definition, title after title."""
    used, out = set(), []
    for title in titles:
        name, k = title, 1
        while name in used:
            name, k = f"{title}_{k}", k + 1
        used.add(name)
        out.append(name + ".md")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_equal_the_fold(spark, seed):
    draw = random.Random(seed)
    pool = [f"a{x}" for x in ("", "_1", "_2", "_3", "_1_1", "_1_2", "_2_1", "_1_1_1", "_1_1_2", "_01", "_10", "_11")] + ["b", "b_2", "b_4", "untitled", "untitled_1"]
    pool = draw.sample(pool, 12)
    rows = [(b if b else None, i, draw.choice(pool)) for b in range(3) for i in range(draw.choice((5, 60, 150)))]
    df = spark.createDataFrame(rows, "batch int, pos int, title string").repartition(5)
    got = {(r.batch, r.pos): r.name for r in unique_names(df, "batch", "pos").collect()}
    for b in (None, 1, 2):
        own = sorted((p, t) for x, p, t in rows if x == b)
        assert [got[b, p] for p, _ in own] == folded([t for _, t in own])


def test_unique_names_with_runs_of_taken_slots(spark):
    titles = [f"a_{k}" for k in range(1, 40)] + ["a"] * 30 + [f"a_{k}" for k in range(45, 60)] + ["a"] * 40 + ["a_70"] * 3 + ["a_1"] * 5
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "batch int, pos int, title string")
    got = unique_names(df, "batch", "pos").orderBy("pos").collect()
    assert [r.name for r in got] == folded(titles)


def test_unique_names_of_nulls_ties_and_nothing(spark):
    schema = "batch string, pos int, title string, name2 string"
    df = spark.createDataFrame([(None, 1, None, "x"), (None, 1, "", "y"), ("", 1, None, "z"), ("", 1, "untitled_1", "w")], schema)
    got = unique_names(df, "batch", "pos")
    assert sorted((r.batch or str(r.batch), r.name) for r in got.collect()) == [("", "untitled.md"), ("", "untitled_1.md"), ("None", "untitled.md"), ("None", "untitled_1.md")]
    assert unique_names(spark.createDataFrame([], schema), "batch", "pos").count() == 0


def test_running_total_over_ranges(spark):
    df = spark.range(2000).select((F.col("id") % 2 * F.col("id") % 3).alias("k"), "id").repartition(7)
    got, _ = running_total(df, ["k"], ["id"], F.col("id"), "t")
    seen, plain = {}, {}
    for i in range(2000):
        k = i % 2 * i % 3
        plain[i] = seen.get(k, 0)
        seen[k] = plain[i] + i
    assert {r.id: r.t for r in got.collect()} == plain


def batches(spark):
    rows = [(b, i, f"t {i % 2}", f"text {b} {i} é" * (i + 1), i != 3) for b in ("a", "a+2", "x/y", "", None) for i in range(5)]
    return spark.createDataFrame(rows, "batch string, pos int, title string, markdown string, success boolean"), rows


def test_archives_round_trip_with_volumes_cap_and_pruning(spark, tmp_path):
    df, rows = batches(spark)
    path = str(tmp_path / "out")
    archives.write_archives(df, path, "batch", "pos", volume_bytes=30)
    assert sorted(os.listdir(path))[0:2] == ["%+2.zip", "%+3.zip"] and not [f for f in os.listdir(path) if f.startswith("_staging")]
    got = archives.read_archives(spark, path)
    assert sorted(bytes(r.body).decode() for r in got.collect()) == sorted(m for _, _, _, m, ok in rows if ok)
    small = archives.read_archives(spark, path, cap=30)
    assert {(r.too_large, r.body is None) for r in small.collect()} == {(True, True), (False, False)}
    one = got.where("archive = 'a.zip'")
    assert one.rdd.getNumPartitions() == 1 and {r.archive for r in one.collect()} == {"a.zip"}
    assert got.where("name = 't_0.md'").count() == 5 and got.where("archive = 'none.zip'").count() == 0


def test_a_failed_task_leaves_no_archive(spark, tmp_path):
    df, _ = batches(spark)
    path = str(tmp_path / "bad")
    broken = df.withColumn("markdown", F.when(F.col("batch") == "x/y", F.raise_error(F.lit("no text"))).otherwise(F.col("markdown")))
    spark.dataSource.register(archives.ArchiveSource)
    rows = broken.select(archives.archive_name(F.col("batch"), F.lit(0)).alias("archive"), F.col("pos").cast("string").alias("name"), F.encode("markdown", "UTF-8").alias("body")).repartition("archive")
    with pytest.raises(Exception, match="no text"):
        rows.write.format(archives.FORMAT).mode("append").option("path", path).save()
    assert not os.path.exists(path) or os.listdir(path) == []


def test_append_refuses_what_is_there_and_overwrite_replaces(spark, tmp_path):
    df, _ = batches(spark)
    path = str(tmp_path / "again")
    archives.write_archives(df.where("batch = 'a'"), path, "batch", "pos")
    with pytest.raises(Exception, match="is there already"):
        archives.write_archives(df.where("batch = 'a'"), path, "batch", "pos")
    assert sorted(os.listdir(path)) == ["_SUCCESS", "a.zip"]
    archives.write_archives(df.where("batch = 'x/y'"), path, "batch", "pos", mode="overwrite")
    assert sorted(os.listdir(path)) == ["_SUCCESS", "x%2Fy.zip"] and zipfile.ZipFile(f"{path}/x%2Fy.zip").namelist() == ["t_0.md", "t_1.md", "t_0_1.md", "t_0_2.md"]


def test_rows_equal_in_batch_and_order_are_refused(spark, tmp_path):
    df, _ = batches(spark)
    with pytest.raises(ValueError, match="equal in pos"):
        archives.write_archives(df.unionByName(df), str(tmp_path / "twice"), "batch", "pos")


def test_many_archives_at_once(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 1000).alias("batch"), F.col("id").alias("pos"), F.lit("n").alias("title"), F.col("id").cast("string").alias("markdown"), F.lit(True).alias("success"))
    path = str(tmp_path / "many")
    archives.write_archives(df, path, "batch", "pos")
    assert len(os.listdir(path)) == 1001
    assert archives.read_archives(spark, path).where("name = 'n_2.md'").selectExpr("sum(cast(cast(body AS string) AS long)) s").first().s == sum(range(2000, 3000))
