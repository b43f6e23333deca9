"""Licence scans with a positional rare-token index, in DataFrame functions only.

A file's licence words (those of the templates, stop words left out) are kept
with their positions. Of each template the words that are rarest over all files
(highest inverse document frequency) are looked up among them, one more than
may be out of place; each hit says where the template would begin in the file.
From there the other words of the template are intersected at their relative
positions, and a template whose
share of words in place is high enough counts once one of its mandatory key
phrases stands in the file word by word. Everything about a file happens in
its own row; only the document counts of the licence words are shuffled.

Defined results: null and empty texts have no words, no labels and score 0;
ties among rare words go by name; each repeated row is reported; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import checkpointed

#: Fixed phrases that decide a label by themselves.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: (label, notice, mandatory key phrases), as lower-case words.
TEMPLATES = (
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
#: Words of the notices that every text uses.
STOP = ("a", "and", "any", "are", "by", "form", "free", "in", "is", "of", "or", "person", "source", "the", "this", "to", "use", "v", "with", "work", "0", "2", "3", "4")
#: Share of a template's licence words that must stand in place.
COVER = 0.6

_VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} - set(STOP))
#: Letters that are lower-cased; all others stand as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words(notice: str) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(notice.split()) if w in _VOCABULARY]


def _places(words: Column, phrase: str) -> Column:
    """Word positions at which a phrase's words stand consecutively."""
    own = phrase.split()

    def fits(i):
        test = F.get(words, i) == own[0]
        for k, w in enumerate(own[1:], 1):
            test = test & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return test

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), fits)


def file_index(documents: DataFrame) -> DataFrame:
    """Per file: n_words, places and labels of base phrases, key phrases met, postings of licence words."""
    joined = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), _NOT_WORD, " "))
    step = documents.select("doc_id", F.concat(F.lit(" "), joined, F.lit(" ")).alias("words"))
    count = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) - 1
    step = step.select("doc_id", "words", F.when(F.length("words") > 2, count).otherwise(0).cast("long").alias("n_words"), F.col("words").rlike(" (" + "|".join(_VOCABULARY) + ") ").alias("some"))
    # A file without licence words or base phrases keeps nothing but its size.
    some = F.col("some") | F.col("words").contains(" cc by nc ")
    step = step.select("doc_id", "n_words", F.when(some, F.col("words")).alias("words"))
    step = step.withColumn("list", F.split(F.trim("words"), " "))
    found = [F.when(F.col("words").contains(f" {p} "), _places(F.col("list"), p)).otherwise(F.array().cast("array<int>")) for p, _ in BASE]
    step = step.withColumn("places", F.array(*found))
    phrases = sorted({k for _, _, keys in TEMPLATES for k in keys})
    keys = F.array_compact(F.array(*[F.when(F.col("words").contains(f" {k} "), F.lit(k)) for k in phrases]))
    posted = F.filter(F.transform("list", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(_VOCABULARY))
    return step.select("doc_id", "n_words", "places", keys.alias("keys"), F.when(F.col("words").isNotNull(), posted).alias("postings"))


def _ranked(index: DataFrame) -> list[str]:
    """Licence words, the rarest over all files first (one count for each word of the templates reaches the driver)."""
    total = index.count()
    words = index.where("postings IS NOT NULL").select(F.explode(F.array_distinct(F.transform("postings", lambda x: x["w"]))).alias("w"))
    df = {r.w: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(_VOCABULARY, key=lambda w: (-math.log((total + 1) / (df.get(w, 0) + 1)), w))


def _coverage(notice: str, ranked: list[str]) -> Column:
    """Share of the template's licence words in place, at the best of the beginnings that its rare words point to.

    A share of COVER leaves fewer words out of place than are looked up, so every beginning that reaches it is pointed to.
    """
    own = _template_words(notice)
    needed = next(n for n in range(1, len(own) + 1) if n / len(own) >= COVER)
    rare = sorted(own, key=lambda x: ranked.index(x[1]))[: len(own) - needed + 1]
    hits = F.filter("postings", lambda x: x["w"].isin([w for _, w in rare]))
    begins = F.flatten(F.transform(hits, lambda x: F.array_compact(F.array(*[F.when(x["w"] == w, x["p"] - t) for t, w in rare]))))

    def share(begin):
        return sum((F.coalesce(F.try_element_at(F.col("at"), begin + t) == w, F.lit(False)).cast("int") for t, w in own), F.lit(0)) / F.lit(float(len(own)))

    return F.coalesce(F.array_max(F.transform(F.array_distinct(begins), share)), F.lit(0.0))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = checkpointed(file_index(documents))
    ranked = _ranked(index)
    some = F.size("postings") > 0
    step = index.withColumn("at", F.when(some, F.map_from_entries("postings")))
    for i, (_, notice, keys) in enumerate(TEMPLATES):
        proven = F.arrays_overlap("keys", F.array(*[F.lit(k) for k in keys]))
        step = step.withColumn(f"c{i}", F.when(some & proven, _coverage(notice, ranked)).otherwise(0.0))
    all_places = F.flatten("places")
    base = [F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]
    more = [F.when(F.col(f"c{i}") >= COVER, F.lit(label)) for i, (label, _, _) in enumerate(TEMPLATES)]
    score = F.greatest(*[F.when(F.col(f"c{i}") >= COVER, F.col(f"c{i}")).otherwise(0.0) for i in range(len(TEMPLATES))])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return step.select(
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base + more).alias("labels"),
        F.when(F.size(all_places) > 0, 1.0).otherwise(score).alias("score"),
    )
