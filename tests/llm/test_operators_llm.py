"""The ten operators against brute force on small tables, and on nulls, empties, ties, copies and odd columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontamination, graph, jaccard_join, language_id, license_scan, line_dedup, multi_index, quality_classifier, sentencepiece_codec, suffix_dedup, url_filter

DOC = "doc_id long, text string"


#: Columns that operators use inside, as strangers in the input.
def odd():
    return {"h": F.lit(1), "t": F.lit("x"), "node": F.lit(2), "words": F.lit(None).cast("string"), "line": F.lit("y"), "a": F.lit(0)}



def docs_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC)
    return df.withColumns(odd())


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---------------------------------------------------------------- 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(800):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[k : k + (kind > 0)] = [] if kind == 1 else [rng.choice("abé")]
        rows.append(("".join(a), "".join(b), distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for edits in (1, 2, 3):
        assert df.where(line_dedup.within("a", "b", edits) != (F.col("d") <= edits)).count() == 0


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 40))) for _ in range(12)]
    texts = []
    for _ in range(25):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        texts.append("\n".join(lines))
    own = "\n".join("".join(rng.choice("mnop ") for _ in range(30)) for _ in range(2))
    texts += [None, "", "short\nshort", own, own, "z" * 5000 + "\n" + "z" * 5001]
    first = {}
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, p))
    near = {b for b in first for a in first if a != b and abs(len(a) - len(b)) <= 2 and first[a] < first[b] and distance(a[:120], b[:120]) <= 2 and (len(a) < 120 or abs(len(a) - len(b)) <= 2)}
    want = {}
    for i, t in enumerate(texts):
        gone = [p for p, line in enumerate((t or "").split("\n")) if len(line) >= 20 and (first[line] != (i, p) or line in near)]
        want[i] = ",".join(map(str, gone))
    df = docs_of(spark, texts)
    assert {r.doc_id: r.dropped for r in line_dedup.report(df).collect()} == want
    kept = {r.doc_id: r.text for r in line_dedup.remove_lines(df).collect()}
    assert 29 not in kept and 28 in kept and kept[25] is None  # a full copy goes, a null stays null
    assert line_dedup.report(df.limit(0)).count() == 0
    assert line_dedup.remove_lines(df).columns == df.columns


def test_line_dedup_of_short_lines_is_brute_force(spark):
    rng = random.Random(21)
    texts = ["\n".join("".join(rng.choice("abcdé1") for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 8, 11, 15)))) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    texts += [None, "", " \t\n \t", "Of, edti oner.\nxyzzy", "Of, edti oner.", "Of, edti oners", "xyzzyx plugh"]
    first = {}
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, p))
    near = {b for b in first for a in first if a != b and first[a] < first[b] and distance(a, b) <= 2}
    want = {i: ",".join(str(p) for p, line in enumerate((t or "").split("\n")) if line.strip() and (first[line] != (i, p) or line in near)) for i, t in enumerate(texts)}
    df = docs_of(spark, texts)
    assert {r.doc_id: r.dropped for r in line_dedup.report(df, min_chars=1).collect()} == want
    assert want[64] == "0" and want[65] == "0"


@pytest.mark.parametrize("hot", [12, 64])
def test_line_dedup_of_hot_segments_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = random.Random(41)
    lines = [f"Annual report of the society, leaf {rng.randrange(3000)}" for _ in range(150)] + [f"{rng.randrange(400):04d} of the leaves é" for _ in range(40)]
    lines += ["".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    texts = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)]
    first = {}
    for i, t in enumerate(texts):
        for p, line in enumerate(t.split("\n")):
            first.setdefault(line, (i, p))
    near = {b for b in first for a in first if a != b and first[a] < first[b] and distance(a, b) <= 2}
    want = {i: ",".join(str(p) for p, line in enumerate(t.split("\n")) if first[line] != (i, p) or line in near) for i, t in enumerate(texts)}
    assert {r.doc_id: r.dropped for r in line_dedup.report(docs_of(spark, texts), min_chars=1).collect()} == want


def test_line_dedup_tells_rows_apart(spark):
    line, other = "x" * 25 + " one line", "another line that stands once only"
    rows = [(1, line), (2, line), (2, other), (2, other), (None, "a line of a row without an id"), (None, None)]
    df = spark.createDataFrame(rows, DOC).withColumns(odd())
    kept = sorted(((r.doc_id, r.text) for r in line_dedup.remove_lines(df).collect()), key=str)
    assert kept == sorted([(1, line), (2, other), (2, other), *rows[4:]], key=str)
    assert sorted((r.doc_id or 0, r.dropped) for r in line_dedup.report(df).collect()) == [(0, ""), (0, ""), (1, ""), (2, ""), (2, ""), (2, "0")]


def test_op1_takes_short_lines(spark, tmp_path):
    from marginalia.llm import queries

    docs_of(spark, ["}\nOf, edti oner.", "Of, edti oner.\n\nqqqqqqqqq"]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.dropped for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()} == {0: "", 1: "0"}


# ---------------------------------------------------------------- 2


def test_license_scan(spark):
    texts = [
        "x y Released under the MIT License. z under the mit license", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "licensed under CC BY-NC 4.0", "All rights reserved.", None, "", "the license of apache and mit stands apart", "mit " * 3000 + "under the mit license",
    ]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels) == (2, 3, 8, "mit")
    assert [got[i].labels for i in range(1, 9)] == ["apache-2", "gpl-3", "cc-by-nc", "all-rights-reserved", "", "", "", "mit"]
    assert got[2].base_labels == "" and got[2].score == 1.0 and got[5].n_words == got[6].n_words == 0 and got[7].score == 0.0
    assert got[8].first_word == 3000 and license_scan.scan(docs_of(spark, texts).limit(0)).count() == 0


def test_license_scan_of_many_notices(spark):
    bsd, mit, mpl, gpl, rights = (next(n for label, n, _ in license_scan.TEMPLATES if label == x and len(n) > (40 if x == "mit" else 0)) for x in ("bsd", "mit", "mpl-2", "gpl-3", "all-rights-reserved"))
    texts = [f"{mpl} x {bsd} y {gpl} z {rights}", f"{bsd} x {mit} y {rights}"] + [rights] * 5 + [gpl] * 3
    got = {r.doc_id: r.labels for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got[0] == "all-rights-reserved,bsd,gpl-3,mpl-2" and got[1] == "all-rights-reserved,bsd,mit"
    # The words that are left are the common ones: a share of 0.6 must still be found.
    texts = ["mozilla public license v 2 terms subject code"] + [gpl.replace("work", "thing").replace("licensed", "given")] + [gpl] * 4
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got[0] == ("", 0.0) and got[1][0] == "gpl-3" and 0.6 <= got[1][1] < 1
    # Only A-Z are lower-cased: a Kelvin sign is no k, a dotted capital I no i.
    texts = ["under the m\u0130t license", "permission is hereby granted free of charge this software redistribution and use in source and binary forms all rights reserved"] + [rights] * 59
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got[0].n_base == 0 and got[0].labels == "" and "all-rights-reserved" in got[1].labels.split(",")


# ---------------------------------------------------------------- 3


def test_multi_index(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[300:420] = x[0]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, 2.0]), (1400, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(odd())
    got = multi_index.search(df, k=10, every=100, centroids=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 100)) and all(len(v) == 10 for v in by.values())
    hit = 0
    for q, rows in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        rows.sort(key=lambda r: r["rank"])
        assert [r.vec_id for r in rows] == sorted([r.vec_id for r in rows], key=lambda v: (d[v], v)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in rows)
        hit += len({r.vec_id for r in rows} & set(best.tolist()))
    assert hit / 60 >= 0.9 and [r.vec_id for r in by[0]] == list(range(300, 310))
    assert multi_index.search(df.limit(0)).count() == 0
    assert multi_index.search(df.where("vec_id in (0, 5)"), every=5).count() == 2


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    cells = multi_index.walk(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)


# ---------------------------------------------------------------- 4


def test_decontamination_is_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = [words(rng, n, 8) for n in (3, 12, 15, 30, 10)] + [None, "", "..."]
    texts = [words(rng, rng.randint(0, 60), 8) for _ in range(20)] + [f"x {items[1]} y {items[0].upper()}!", None, "", f"{items[2]} {items[2]}", f"{items[4]}"]
    want = {}
    for d, t in enumerate(texts):
        w = [x.decode() for x in decontamination.tokens((t or "").encode())]
        hit, found = set(), set()
        for i, item in enumerate(items):
            own = [x.decode() for x in decontamination.tokens((item or "").encode())]
            n = min(10, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        want[d] = (len(w), len(hit), len(found), decontamination.digest_of(found), bool(hit))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumns(odd())
    df = docs_of(spark, texts)
    for size in (1 << 19, 7):  # in one block, and in several
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", size)
        got = decontamination.report(decontamination.find_overlaps(df, bench)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert decontamination.report(decontamination.find_overlaps(df, bench.limit(0))).where("contaminated").count() == 0
    kept = {r.doc_id for r in decontamination.remove_contaminated(df, bench).collect()}
    assert kept == {d for d, x in want.items() if not x[4]}


def test_decontamination_is_the_same_in_any_number_of_blocks(spark, monkeypatch):
    items = [" ".join(f"{c}{k}" for k in range(12)) for c in "abc"]
    rows = [(1, "x y z"), (1, "x y w"), (2, f"{items[0]} {items[2]}"), (2, " ".join(f"q{k}" for k in range(24))), (2, f"{items[0]} {items[2]}"), (None, items[1]), (3, None)]
    df = spark.createDataFrame(rows, DOC).withColumns(odd())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    seen = []
    for size in (1 << 19, 2):
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", size)
        seen.append(sorted(map(str, decontamination.report(decontamination.find_overlaps(df, bench)).collect())))
        kept = sorted(((r.doc_id, r.text) for r in decontamination.remove_contaminated(df, bench).collect()), key=str)
        assert kept == sorted([rows[0], rows[1], rows[3], rows[6]], key=str)
    assert len(seen[0]) == len(rows) and seen[0] == seen[1]


def test_proximity_matches_are_brute_force(spark):
    rng = random.Random(22)
    items = [words(rng, n, 40) for n in (24, 12, 4, 10)]
    own = items[0].split()
    texts = [" ".join(x for k in range(0, 24, 6) for x in (*own[k : k + 6], "new")), " ".join(reversed(items[1].split())), items[3][: len(items[3]) // 2], items[3][len(items[3]) // 2 :], None, ""]
    texts += [words(rng, 120, 40) for _ in range(6)] + [f"{words(rng, 9, 40)} {items[2]} x {items[2]}"]
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = (t or "").split(), set(), set()
        for i, item in enumerate(items):
            x = item.split()
            for k in range(len(x) - min(10, len(x)) + 1):
                terms = set(x[k : k + 10])
                for a in range(len(w)):
                    if w[a] in terms:
                        end = next((b for b in range(a + 1, min(a + 20, len(w)) + 1) if terms <= set(w[a:b])), None)
                        if end:
                            hit |= set(range(a, end))
                            found.add(i)
        want[d] = (hit, sorted(found))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.find_overlaps(docs_of(spark, texts).coalesce(1), bench).sort("doc_id").collect()
    assert {r.doc_id: ({p for h in r.near_hits for p in range(h.start, h.stop)}, r.near_item_ids) for r in got} == want
    assert got[0].item_ids == [] and got[0].near_item_ids == [0] and want[1][1] == [1]


def test_proximity_matches_are_the_same_in_any_number_of_blocks(spark, monkeypatch):
    rng = random.Random(5)
    bench = spark.createDataFrame([(i // 2, words(rng, n, 12)) for i, n in enumerate((14, 12, 4, 30, 1, 10))], "item_id long, text string")
    df = docs_of(spark, [words(rng, 80, 12) for _ in range(8)] + [None, "w1"])
    seen = []
    for size, places in ((1 << 19, 1 << 20), (3, 5)):
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", size)
        monkeypatch.setattr(decontamination, "PLACES", places)
        seen.append(sorted(map(str, decontamination.find_overlaps(df, bench).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 10


def test_a_frequent_term_and_shared_windows(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    bench = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(30)] + [(90, "the " * 10)], "item_id long, text string")
    df = docs_of(spark, ["the " * 3000, f"x {shared} y", "the " * 9, f"the {shared} own7"])
    got = {r.doc_id: r for r in decontamination.find_overlaps(df, bench).collect()}
    assert got[0].item_ids == [90] and [tuple(h) for h in got[0].hits] == [(0, 3000)]
    assert got[1].item_ids == list(range(30)) and [tuple(h) for h in got[1].hits] == [(1, 13)]
    assert got[2].item_ids == [] and got[2].near_item_ids == [90]
    assert got[3].item_ids == list(range(30)) and [tuple(h) for h in got[3].hits] == [(1, 14)]


def test_proximity():
    ids = np.array([0, 9, 1, 9, 9, 9, 2, 0, 1, 2])
    terms, counts = np.unique(ids, return_counts=True)
    index = decontamination.PositionalIndex(terms, counts, np.argsort(ids, kind="stable"))
    ranks, whole = index.ranks(np.array([[0, 1, 2], [0, 1, 5]]))
    assert whole.tolist() == [True, False]
    row, at = index.near(ranks[:1], 3)
    assert at.tolist() == [7] and index.exact(ranks[:1], np.array([[0, 1, 2]]), row, at)[1].tolist() == [7]
    assert [x.tolist() for x in index.stretches(ranks[:1], row, at, 4)] == [[0, 0], [6, 7], [9, 10]]


# ---------------------------------------------------------------- 5


@pytest.fixture(scope="module")
def model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def test_codec_is_the_library(spark, model):
    codec = sentencepiece_codec.Codec(model)
    rng = random.Random(4)
    pool = [*" ab \n\t▁é漢😀\x00ﬁ.'", "the ", " of", "  ", "▁▁", "word"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(1500)] + [None, "", " ", "x" * 50_000]
    for text, (raw, plain, covered) in zip(texts, codec.encode_batch(texts)):
        ids = codec.engine.encode(text or "", add_bos=True, add_eos=True)
        assert raw == np.array(ids, "<u4").tobytes() and plain == codec.engine.decode(ids) and covered == len((text or "").encode())
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs_of(spark, texts[-6:]), model).collect()}
    ids = codec.engine.encode(texts[-6] or "", add_bos=True, add_eos=True)
    assert got[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[2].n_tokens == 2
    assert sentencepiece_codec.encode_documents(docs_of(spark, ["x"]).limit(0), model).count() == 0


def test_spans_tile_the_source(spark, model):
    for text in ("naïve  café ▁x", "漢字 and 😀\n"):
        spans = sentencepiece_codec.Codec(model).spans(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text.encode()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def hand_made_map():
    """A double array for "a" -> "x" and "ab" -> "yz", as in the test of the longest prefix."""
    units = [0] * 1024
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a], units[a ^ 512] = (512 << 10) | 256 | ord("a"), 0
    b = (a ^ 512) ^ ord("b")
    units[b], units[b ^ 768] = (768 << 10) | 256 | ord("b"), 2
    return (4096).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"


def library_spans(engine, text):
    """(first byte, end byte, id) of each piece as the library aligns it, None for bytes of a character: it gives them no share."""
    at = [0, *np.cumsum([len(c.encode()) for c in text]).tolist()]
    found = engine.encode(text, return_type="offset_mapping")
    return [None if engine.is_byte(i) else (at[a], at[b], i) for i, (a, b) in zip(found["ids"], found["offsets"])]


def test_every_piece_is_projected(spark, model):
    codec = sentencepiece_codec.Codec(model)
    rng = random.Random(8)
    pool = [*" ab \n\t▁é漢😀\x00ﬁ.'", "the ", " of", "  ", "▁▁", "word"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(400)] + ["plain words only", " ", "", None]
    rows = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs_of(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        spans = codec.spans(text or "")
        assert all(want is None or got == want for got, want in zip(spans, library_spans(codec.engine, text or ""), strict=True))
        assert [x[0] for x in spans] == [0, *(x[1] for x in spans)][: len(spans)]  # bytes of a character too: nothing is left out
        raw = np.array([x[:2] for x in spans], "<u4").tobytes()
        assert rows[i].spans_sha256 == hashlib.sha256(raw).hexdigest() and rows[i].n_span_bytes == len((text or "").encode())


def test_rows_come_through_the_character_map(model):
    codec = sentencepiece_codec.Codec(model)
    codec.map = sentencepiece_codec.CharacterMap(hand_made_map())
    raw, plain, _ = codec.encode("ab word ca")
    assert raw == np.array(codec.engine.encode("yz word cx", add_bos=True, add_eos=True), "<u4").tobytes() and plain == "yz word cx"
    assert codec.spans("ab")[-1][1] == 2


@pytest.mark.parametrize("strip", [False, True])
def test_models_with_a_character_map(tmp_path, strip):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(9)
    lines = [" ".join("".join(rng.choices("abcdefi", k=rng.randint(1, 6))) for _ in range(8)) for _ in range(200)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=str(tmp_path / "m"), vocab_size=400, model_type="bpe", byte_fallback=True,
        normalization_rule_name="nmt_nfkc", remove_extra_whitespaces=strip, minloglevel=2,
    )
    codec = sentencepiece_codec.Codec(str(tmp_path / "m.model"))
    assert codec.map.begins.any() and codec.strip == strip
    pool = [*" abcdef ", "ﬁ", "ａｂ", "\u3000", "\u00a0", "①", "e\u0301", "漢", "\t", "\n", "  ", "㌔"]
    for _ in range(600):
        text = "".join(rng.choices(pool, k=rng.randint(0, 10)))
        ids = codec.engine.encode(text, add_bos=True, add_eos=True)
        raw, plain, _ = codec.encode(text)
        assert raw == np.array(ids, "<u4").tobytes() and plain == codec.engine.decode(ids), repr(text)
        got, want = codec.spans(text), library_spans(codec.engine, text)
        assert all(w is None or g == w for g, w in zip(got, want, strict=True)), repr(text)


def test_character_map_takes_the_longest_prefix():
    # A double array for "a" -> "x" and "ab" -> "yz", laid out by hand: a node's children stand at node ^ offset ^ byte.
    units = [0] * 1024
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = (512 << 10) | 256 | ord("a")
    units[a ^ 512] = 0
    b = (a ^ 512) ^ ord("b")
    units[b] = (768 << 10) | 256 | ord("b")
    units[b ^ 768] = 2
    blob = (4096).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    table = sentencepiece_codec.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz") and table.longest(b"ac", 0) == (1, b"x") and table.longest(b"c", 0) is None


# ---------------------------------------------------------------- 6


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def near_copies(rng, n):
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(10, 120))] for _ in range(6)]
    out = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            own[rng.randrange(len(own))] = f"v{rng.randrange(500)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_jaccard_join_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_FEATURES", block)
    texts = [*near_copies(random.Random(6), 80), None, "", "one two", "ONE two", " ", "one two three"]
    got = jaccard_join.components_of(docs_of(spark, texts), n=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4, 85)


def test_jaccard_join_keeps_one_of_each(spark):
    texts = [*near_copies(random.Random(7), 30), None, ""]
    want = {i for i, (_, c) in brute_components(texts, 5, 80).items() if c == i}
    df = docs_of(spark, texts)
    assert {r.doc_id for r in jaccard_join.keep_first(df).collect()} == want
    assert jaccard_join.components_of(df.limit(0)).count() == 0


def test_jaccard_join_tells_rows_apart(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " x"), (2, b), (None, a), (7, "c d e f g h"), (7, "c d e f g h i")]
    df = spark.createDataFrame(rows, DOC).withColumns(odd())
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_first(df).collect()), key=str)
    # The unique text of doc_id 2 stays with its repeated row; (7, ...) are told apart and not similar enough.
    assert kept == sorted([(1, a), (2, b), (2, b), (7, "c d e f g h"), (7, "c d e f g h i")], key=str)
    got = [(r.doc_id, r.component_id) for r in jaccard_join.components_of(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (2, 2), (3, 2), (2, 2), (None, 1), (7, 7), (7, 7)], key=str)


@pytest.mark.parametrize("bound", [2, 256])
def test_hot_signatures_become_families(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard_join, "HOT_NODES", bound)
    rng = random.Random(31)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = []
    for _ in range(60):  # one large group of near copies, all different
        own = list(base)
        own[rng.randrange(60)] = f"v{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    texts += near_copies(rng, 30)
    got = jaccard_join.components_of(docs_of(spark, texts).coalesce(1), n=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4, 85)


def test_signatures_of_all_turns_are_the_whole():
    rng = np.random.default_rng(4)
    ends = jaccard_join.bands(80)
    for size in (3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        parts = [jaccard_join.signatures(a, ends, 80, k, 3).tolist() for k in range(3)]
        assert sorted(sum(parts, [])) == sorted(jaccard_join.signatures(a, ends, 80).tolist())


def test_signatures_and_sketches_lose_no_link():
    rng = np.random.default_rng(2)
    ends = jaccard_join.bands(85)
    for _ in range(150):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(5, 400)).astype(np.uint64))
        swap = rng.integers(0, max(1, len(a) // 12) + 1)
        b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 60, swap).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and both < len(a):
            shared = set(jaccard_join.signatures(a, ends, 85).tolist()) & set(jaccard_join.signatures(b, ends, 85).tolist())
            assert shared
            parity = shared.pop() & 1
            s = [jaccard_join.sketch(x, ends, 85)[parity] for x in (a, b)]
            assert len(set(jaccard_join.bucket_links(np.array([len(a), len(b)]), s, 85, parity))) == 1


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 330)]
    comp = {v: v for e in edges for v in e}
    for a, b in edges:
        x, y = comp[a], comp[b]
        comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in comp.items() if v in got} and all(comp[v] == v and list(comp.values()).count(v) == 1 for v in comp if v not in got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 7


def test_url_filter(spark):
    urls = ["https://Sub.Example.COM/en/71?x=1", "http://a.com/en/1", "http://b.example.net/de/8x", "http://c.net/de/9", "http://d.org/es/", None, "no scheme", "http://xexample.com/en/7", "https://best-casino.biz/slots/bonus/jackpot", "https://library.edu/history/lecture", "http://a.com//en/://x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns(odd())
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[i].rule for i in range(8)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None, None, "com/en/"]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 7, 8, 9)] == ["allow", "block", "block", "allow", "block", "block", "block", "allow"]
    assert (got[0].host, got[0].path, got[5].host, got[6].path) == ("sub.example.com", "/en/71", "", "")
    assert all((got[i].host, got[i].path) == url_filter.split(u) for i, u in enumerate(urls))
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_filter_blocks_unseen_spam_hosts(spark):
    spam = ["http://m.casino-win.example.com/fr/7054.html", "http://free-bets.example.com/fr/1258", "https://m.ads-track.example.com/de/6855", "https://www.cheap-pills.example.com/de/77", "http://blog.adult-x.example.net/en/330.html", "http://example.com/casino/bonus", "https://xxx-cams.tv/live"]
    neutral = ["https://blog.tionsh.example.com/de/31", "http://tionble.example.net/fr/2998/", "https://m.ththth.example.net/es/12", "https://www.ththon.example.com/de/9", "https://library.edu/history/lecture"]
    trained = {url_filter.split(u)[0] for u, _ in url_filter.LABELLED}
    assert not trained & {url_filter.split(u)[0] for u in spam + neutral}
    df = spark.createDataFrame(list(enumerate(spam + neutral)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, rules=()).collect()}
    assert [got[i] for i in sorted(got)] == ["block"] * len(spam) + ["allow"] * len(neutral)


# ---------------------------------------------------------------- 8


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = {}
    for i, b in enumerate(data):
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(30)) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    texts += [None, "", texts[3], "q" * 200, "ab" * 60]
    got = suffix_dedup.remove_repeats(docs_of(spark, texts), length=40, gram=12).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(texts, 40)


def test_longest_previous_factors():
    rng = random.Random(10)
    for _ in range(60):
        s = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40)))
        want = [max([0, *(next((k for k in range(len(s) - i) if s[i + k] != s[j + k]), len(s) - i) for j in range(i))]) for i in range(len(s))]
        assert suffix_dedup.longest_previous_factor(s).tolist() == want
    masks = suffix_dedup.later_copies([b"abcdefgh", b"xxabcdefgh", b"abc"], 5)
    assert [m.sum() for m in masks] == [0, 8, 0]


def test_whole_matches_are_those_of_the_factor_arrays():
    rng = random.Random(51)
    for _ in range(40):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60)))
        depth, x = 4, np.frombuffer(data, np.uint8)
        starts = np.arange(max(len(data) - depth + 1, 0))
        before, after = suffix_dedup.matches_before_and_after(suffix_dedup.suffix_array(x, depth)[starts], starts, depth)
        lpf = suffix_dedup.longest_previous_factor(data)
        assert (before >= depth).tolist() == (lpf[: len(starts)] >= depth).tolist()
        later = [any(data[j : j + depth] == data[i : i + depth] for j in range(i + 1, len(starts))) for i in starts]
        assert (after >= depth).tolist() == later


# ---------------------------------------------------------------- 9 and 10


def labelled(spark, n=400):
    rng = random.Random(11)
    alphabet = {"xx": "aeioulmnr", "yy": "zkwtsgpqu"}
    rows = []
    for i in range(n):
        lang = rng.choice(("xx", "yy"))
        text = " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(8, 30)))
        good = rng.random() < 0.7
        rows.append((i, text if good else " ".join(w + "%%%" for w in text.split()), lang, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").withColumns(odd())


def test_language_id(spark):
    df = labelled(spark)
    more = spark.createDataFrame([(9001, None, "xx", 0), (9002, "12 34 !", "yy", 0), (9003, "", None, 0), (9004, "zkw " * 20_000, None, 0)], "doc_id long, text string, lang string, quality int").withColumns(odd())
    got = {r.doc_id: r for r in language_id.identify(df.unionByName(more)).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert [got[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "yy"] and got[9001].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(df.unionByName(more))
    assert kept.columns == df.columns and kept.where("doc_id >= 9001").count() == 1
    assert language_id.identify(df.limit(0)).count() == 0 and language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_code_lengths_are_exact():
    trees = language_id.ContextTrees({"xx": [b"abab"], "yy": [b"ba"]})
    bits = trees.lengths(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    # In xx: 'a' after nothing was seen once of one kind: 1 of 2; 'b' after "a" likewise: 1 of 2.
    assert abs(bits[0, 0] - 2.0) < 1e-5
    assert trees.lengths(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [[0.0, 0.0]]


def test_quality_classifier(spark):
    df = labelled(spark, 600)
    labels = df.select("doc_id", "quality")
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "w " * 30_000)], DOC).withColumns(odd())
    got = {r.doc_id: r for r in quality_classifier.score(df.drop("lang", "quality").unionByName(more), labels.unionByName(labels.limit(5))).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values()) and 9001 in got
    assert {r.score for r in quality_classifier.score(df, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(df.limit(0), labels).count() == 0


def test_isotonic():
    level = quality_classifier.isotonic(np.array([1.0, 1, 0, 2, 1]), np.array([1.0, 0, 0, 1, 1]))
    assert (np.diff(level) >= 0).all() and level[-1] == 1.0 and level[0] == 0.5


# ---------------------------------------------------------------- the pipeline


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path, model):
    import corpus_pipeline

    rng = random.Random(12)
    texts = ["\n".join(words(rng, 12, 400) for _ in range(4)) for _ in range(12)]
    item = words(rng, 12, 900)
    texts += [texts[0], "123 ...", None, f"{words(rng, 20, 400)} {item} {words(rng, 5, 400)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12))  # the copy, the one without letters, the null and the contaminated one went
    codec = sentencepiece_codec.Codec(model)
    assert all(got[i].n_tokens == len(codec.engine.encode(texts[i], add_bos=True, add_eos=True)) for i in got)
    columns = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = stage(spark, columns, str(tmp_path))
        assert columns.columns == docs.columns
