"""Unique file names of a batch, as a distributed form of "the first of name, name_1, name_2, ... that nobody took".

Each name has at most two claimants: the title that reads so itself, by its first
row, and the title without the last number, by that slot. So a title's rows take
its slots in order, and a slot is passed over exactly where the title that reads
like it came first. Only titles that look like another title's slot need care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import text_of
from marginalia.session import checkpointed, dropped

NAME_CHARS = 100
#: A title that reads like a slot of another: its stem and the slot's number.
SLOT = r"^(.+)_([1-9][0-9]{0,17})\z"


def file_name(title, most: int = NAME_CHARS):
    """Letters safe for file systems, white space and dots as single underscores, cut; ``untitled`` for nothing."""
    c = F.regexp_replace(text_of(title), r'[<>:"/\\|?*\x00-\x1F]', "")
    c = F.regexp_replace(c, r"[\s.]+", "_")
    c = F.regexp_replace(F.regexp_replace(c, "_+", "_"), r"^_+|_+\z", "")
    c = F.regexp_replace(F.substring(c, 1, most), r"_+\z", "")
    return F.when(c == "", "untitled").otherwise(c)


def running_total(df: DataFrame, keys: list[str], order: list[str], value, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``name``, the total of ``value`` over the earlier rows of the same keys, and the table it reads.

    No task gathers a key: rows are cut into ranges in order, added up within
    each range, and a range is given what stands before it. Only a key that
    begins in an earlier range needs that, so there is at most one such row a range.
    The caller deletes the second table once the first is written.
    """
    ranged = df.withColumn("_v", value.cast("long")).repartitionByRange(*keys, *order)
    placed = checkpointed(ranged.withColumn("_range", F.spark_partition_id()))
    pieces = placed.groupBy("_range", *keys).agg(F.sum("_v").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = pieces.select("_range", *keys, before.alias("_carried")).where("_carried IS NOT NULL")
    carried = carried.select(F.col("_range").alias("_r2"), *[F.col(k).alias(f"{k}2") for k in keys], "_carried")
    own = F.sum("_v").over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    match = F.col("_range") == F.col("_r2")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}2"))
    out = placed.withColumn("_own", own).join(F.broadcast(carried), match, "left")
    out = out.withColumn(name, F.col("_own") + F.coalesce("_carried", F.lit(0)))
    return out.drop("_v", "_range", "_own", "_r2", "_carried", *[f"{k}2" for k in keys]), placed


def _decided(pairs: DataFrame) -> DataFrame:
    """Whether each slot is passed over, slots of a title in order: it is if the title had fewer rows before than slots to fill.

    A group holds the different titles that read like slots of one title, three numbers each.
    """

    def run(pdf):
        pdf = pdf.sort_values("slot")
        passed, out = int(pdf["start"].iloc[0]), []
        for slot, rows in zip(pdf["slot"].tolist(), pdf["rows_before"].tolist()):
            gone = slot + 1 - passed > rows
            passed += gone
            out.append(gone)
        return pdf.assign(passed=out)[["batch_key", "stem", "slot", "child", "passed"]]

    flat = pairs.select(F.col("_b").alias("batch_key"), F.col("_base").alias("stem"), F.col("_slot").alias("slot"), F.col("_child").alias("child"), F.col("rows_before"), "start")
    kind = f"batch_key {pairs.schema['_b'].dataType.simpleString()}, stem string, slot long, child string, passed boolean"
    done = flat.groupBy("batch_key", "stem").applyInPandas(run, kind)
    return done.select(F.col("batch_key").alias("_b"), F.col("stem").alias("_base"), F.col("slot").alias("_slot"), F.col("child").alias("_child"), "passed")


def _passed_slots(pairs: DataFrame) -> DataFrame:
    """(_b, _base, _slot): slots that a title's rows pass over; 0 where its own name was taken.

    A title's start depends on the title it reads like a slot of, so titles are
    settled from the shortest on, a round for each further number in a name.
    """
    children = pairs.select("_b", F.col("_child").alias("_base")).distinct()
    level = pairs.alias("p").join(children.alias("c"), F.col("p._b").eqNullSafe(F.col("c._b")) & (F.col("p._base") == F.col("c._base")), "left_anti").withColumn("start", F.lit(0))
    found = []
    while True:
        done = checkpointed(_decided(level))
        found.append(done.where("passed").select("_b", "_base", "_slot"))
        found.append(done.where("NOT passed").select("_b", F.col("_child").alias("_base"), F.lit(0).cast("long").alias("_slot")))
        settled = done.select(F.col("_b").alias("_b2"), F.col("_child").alias("_c2"), (~F.col("passed")).cast("int").alias("start"))
        level = checkpointed(pairs.join(settled, F.col("_b").eqNullSafe(F.col("_b2")) & (F.col("_base") == F.col("_c2"))).drop("_b2", "_c2"))
        if level.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return checkpointed(out)


def unique_names(df: DataFrame, batch: str, order: str, title: str = "title") -> DataFrame:
    """``name`` for each row: its file name, or the first of _1, _2, ... that no earlier row of the batch took, with ``.md``.

    ``order`` is not null; rows equal in it come in the order of their file names, and those equal in both share
    their names in any order. A null batch is a batch of its own, a null title ``untitled``, an empty table stays empty.
    """
    rows = df.withColumns({"_b": F.col(batch), "_base": file_name(F.col(title)), "_o": F.col(order)})
    bases = rows.groupBy("_b", "_base").agg(F.min("_o").alias("_o"))
    slots = bases.where(F.col("_base").rlike(SLOT)).select(
        F.col("_b").alias("_b2"), F.regexp_extract("_base", SLOT, 1).alias("_stem"), F.regexp_extract("_base", SLOT, 2).try_cast("long").alias("_slot"), F.col("_base").alias("_child"), F.col("_o").alias("_first")
    )
    pairs = bases.drop("_o").join(slots, F.col("_b").eqNullSafe(F.col("_b2")) & (F.col("_base") == F.col("_stem")))
    probes = checkpointed(pairs.select("_b", "_base", F.col("_first").alias("_o"), "_slot", "_child"))
    both = rows.withColumn("_probe", F.lit(0)).unionByName(probes.withColumn("_probe", F.lit(1)), allowMissingColumns=True)
    ranked, placed = running_total(both, ["_b", "_base"], ["_o", "_probe"], F.col("_probe") == 0, "_before")
    mine = ranked.where("_probe = 0").drop("_slot", "_child", "_probe", "_o")
    if probes.isEmpty():
        numbered, spent = mine.withColumn("_shift", F.lit(0)), [placed, probes]
    else:
        passed = _passed_slots(checkpointed(ranked.where("_probe = 1").select("_b", "_base", "_slot", "_child", F.col("_before").alias("rows_before"))))
        nth = F.row_number().over(Window.partitionBy("_b", "_base").orderBy("_slot"))
        marks = passed.select("_b", "_base", (F.col("_slot") - nth + 1).alias("_before"))  # the row from which on this slot has been passed
        touched = marks.select(F.col("_b").alias("_b2"), F.col("_base").alias("_base2")).distinct()
        same = F.col("_b").eqNullSafe(F.col("_b2")) & (F.col("_base") == F.col("_base2"))
        plain = mine.join(touched, same, "left_anti").withColumn("_shift", F.lit(0).cast("long"))
        met = mine.join(touched, same, "left_semi").withColumn("_row", F.lit(1)).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
        shifted, second = running_total(met, ["_b", "_base"], ["_before", "_row"], F.col("_row") == 0, "_shift")
        numbered, spent = plain.unionByName(shifted.where("_row = 1").drop("_row")), [placed, probes, second]
    place = F.col("_before") + F.col("_shift")
    name = F.concat("_base", F.when(place > 0, F.concat(F.lit("_"), place.cast("string"))).otherwise(""), F.lit(".md"))
    out = checkpointed(numbered.select(*[F.col(f"`{c}`") for c in df.columns], name.alias("name")))
    dropped(*spent)
    return out
