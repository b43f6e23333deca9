"""Quality score, fingerprints, tokens and the near-duplicate gate."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import near_duplicates, quality
from marginalia.plans import registry

ARTICLE = "\n\n".join(
    f"The council met on day {i} to discuss the harbour bridge, and after a long debate about costs and safety the members agreed "
    f"that engineers should inspect every pillar number {i} before the winter storms arrive again on the northern coast." for i in range(12)
)
COUPON = "Use code SAVE10 for 20% off. Limited time offer! Buy now, free shipping, exclusive deal. Coupon codes and promo codes. Click here, sign up now. " * 8


def judged(spark, rows):
    df = spark.createDataFrame(rows, "id long, markdown string, query string, url string")
    got = quality.scored(quality.measures(df, "markdown", F.col("query"), F.col("url")))
    return {r.id: r for r in got.collect()}


def test_articles_stay_and_pitches_go(spark):
    pitch = "Join the VIP channel with paid signals and guaranteed profit. " + ARTICLE
    chan = "Our telegram channel costs $30 per month. Every whatsapp group is for paying members. " + ARTICLE
    news = "The newspaper runs a telegram channel, and a signal channel is written make(chan os.Signal) in code. " + ARTICLE
    got = judged(spark, [(1, ARTICLE, "harbour bridge costs", "https://a.com/x"), (2, COUPON, "", ""), (3, pitch, "", ""), (4, chan, "", ""), (5, news, "", ""), (6, None, "", None), (7, "", "", "")])
    assert got[1].verdict == "keep" and got[1].score < 100
    assert got[2].verdict == "reject" and "promotional phrases" in got[2].reason
    assert got[3].verdict == "reject" and got[3].signal_selling_hits >= 2
    assert got[4].channel_pitch_hits == 2 and got[5].channel_pitch_hits == 0 and got[5].verdict == "keep"
    assert got[6].word_count == got[7].word_count == 0 and got[6].score == 35


def test_every_match_of_a_phrase_holds_its_literal():
    """Texts made of a pattern's own alternatives, with and without its optional parts: each matches, and holds what the text is searched for first."""
    for pattern in (*quality.PROMO, *quality.CTA, *quality.SIGNALS, *quality.CHANNELS):
        some = [pattern.replace(r"\b", "").replace(r"\d+", "7").replace("[- ]", "-")]
        while any("(?:" in x for x in some):
            some = [x.replace(g.group(0), alt, 1) for x in some for g in [re.search(r"\(\?:([^()]*)\)\??", x)] for alt in [*g.group(1).split("|"), *[""] * g.group(0).endswith("?")]]
        some = [y for x in some for y in (re.sub(r"(.)\?", r"\1", x), re.sub(r".\?", "", x))]
        assert some and all(re.search(pattern, x) and quality.literal_of(pattern) in x for x in some), pattern
        assert len(quality.literal_of(pattern)) > 1


def test_measures_of_odd_white_space(spark):
    """Wide spaces, tabs and carriage returns count like spaces, at the edges of lines, in links and between marks, too."""
    plain = "# A Head\n\n  one two  three\n ONE two three \n##none\n*x* [a b](https://b.org/go/1?tag=x) | y\n" + " ".join(f"w{i}" for i in range(25)) + "\nuse code A 50% off"
    odd = plain.replace("  ", "\u00a0\t").replace("# A", "#\u3000A").replace("a b", "a\u2003\r b").replace("x* ", "x*\ufeff").replace("w1 ", "w1\x0b\u2028").replace("A 50% off", "A\t50% off\u202f")
    got = judged(spark, [(1, plain, "what use", "https://a.com/"), (2, odd, "what use", "https://a.com/")])
    assert [got[1][c] for c in quality.STATS] == [got[2][c] for c in quality.STATS]
    one = got[1]
    assert (one.word_count, one.headings, one.link_count, one.link_text_words, one.affiliate_links, one.outbound_links) == (43, 1, 1, 2, 1, 1)
    assert one.duplicate_line_share == 1 / 7 and one.substantial_word_share == 25 / 43 and one.promo_per_1000 == 2 * (1000 / 43) and got[1].reasons == got[2].reasons


def test_links_are_counted_and_code_is_not(spark):
    text = "See [the study](https://b.org/study) and [buy](https://shop.com/go/1?tag=x).\n\n```\nuse code A, click here\n```\n"
    got = judged(spark, [(1, text, "", "https://a.com/")])[1]
    assert (got.link_count, got.affiliate_links, got.outbound_links) == (2, 1, 2)
    assert got.promo_per_1000 == 0 and got.cta_per_1000 == 0


def test_off_topic_lists_go_and_prose_stays(spark):
    links = "\n".join(f"- [entry number {i}](https://x.com/{i})" for i in range(60))
    got = judged(spark, [(1, links, "harbour bridge", ""), (2, ARTICLE, "quantum chromodynamics", "")])
    assert got[1].verdict == "reject" and got[2].verdict == "keep"


def test_fingerprints(spark):
    df = spark.createDataFrame([("one two three four five six",), ("too short",), (None,)], "t string").select(quality.fingerprint(F.col("t")).alias("p"))
    sizes = [len(r.p) for r in df.collect()]
    assert sizes == [1, 0, 0]
    assert spark.range(1).select(quality.fnv1a(F.lit("hello")).alias("h")).first().h == 1335831723


def test_tokens(spark):
    df = spark.createDataFrame([("hi",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(quality.token_heuristic(F.col("t"))).collect()] == [2, 0, 0]
    plain = [r.tokens for r in quality.ranked_tokens(df, "t", {}).collect()]
    merged = [r.tokens for r in quality.ranked_tokens(df, "t", {b"hi": 5}).collect()]
    assert plain == [2, 0, 0] and merged == [1, 0, 0]
    r = spark.range(1).select(quality.limit_report(F.lit(2), 4).alias("r"), quality.limit_report(F.lit(6), 4).alias("s")).first()
    assert (r.r.percentage, r.r.remaining, r.s.is_over_limit, r.s.remaining) == (50.0, 2, True, 0)


def test_gate_is_the_sequential_scan(spark):
    rng = random.Random(5)
    base = [[rng.randrange(300) for _ in range(40)] for _ in range(3)]
    rows = []
    for i in range(60):
        own = set(rng.choice(base))
        for x in rng.sample(sorted(own), rng.randrange(8)):
            own.discard(x)
            own.add(rng.randrange(300))
        rows.append((i, sorted(own) if rng.random() > 0.1 else [], rng.random() < 0.2))
    rows.append((60, rows[3][1], False))
    kept, want = [], {}
    for i, s, junk in rows:
        hit = next((j for j, t in kept if s and t and len(set(s) & set(t)) * 4 >= 3 * len(set(s) | set(t))), None)
        want[i] = ("duplicate", hit) if hit is not None else ("junk", None) if junk else ("accepted", None)
        if want[i][0] == "accepted":
            kept.append((i, s))
    df = spark.createDataFrame(rows, "id long, prints array<long>, junk boolean")
    assert {r.id: (r.disposition, r.named) for r in near_duplicates.gate(df).collect()} == want


def test_gate_keeps_the_far_end_of_a_chain(spark):
    words = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words[:50])), (2, " ".join(words[6:56])), (3, " ".join(words[12:62]))], "doc_id long, text string")
    got = near_duplicates.gate(near_duplicates.fingerprints(docs).withColumn("junk", F.lit(False)))
    assert [r.disposition for r in got.orderBy("id").collect()] == ["accepted", "duplicate", "accepted"]


def test_members_are_found_without_pairs(spark, tmp_path, monkeypatch):
    def unwanted(*args, **more):
        raise AssertionError("members need neither postings nor fingerprints")

    rng = random.Random(6)
    pool = ["a", "b", "B", "c1", "é", "K", "İ", "```", "[x](http://u/v w)", "![a b](c)", "\n", "\u00a0", "\u3000", "-", "😀"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(300)] + [None, "", "a a a a a a", "a a a a a a a", "A-a a\ta a,a", "a " * 5]
    texts += ["vic wes una kay kay tom", "ada fox jim una pam leo"]  # one 32-bit fingerprint, two sets
    docs = spark.createDataFrame([(500 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first, sets = {}, {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", quality.shingle_texts(F.col("text")).alias("s")).collect()}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert len(first) < len([x for x in sets.values() if x])  # some are equal
    for name in ("_posted", "_keyed", "fingerprints"):
        monkeypatch.setattr(near_duplicates, name, unwanted)
    got = {r.doc_id: r.class_id for r in registry.near_dup_members(spark, str(tmp_path)).collect()}
    assert got == {i: first[s] for i, s in sets.items() if s}
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert registry.near_dup_members(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(near_duplicates, "AT_ONCE", 1)
    whole = near_duplicates.set_keys(pa.array(texts)[3:]).to_pylist()
    assert whole == [near_duplicates.set_keys(pa.array([t], pa.string()))[0].as_py() for t in texts[3:]]


def brute_pairs(rows, percent):
    """Groups of equal sets by their smallest id, and their pairs."""
    first = {}
    for i, s in sorted(rows):
        if s:
            first.setdefault(frozenset(s), i)
    heads = sorted((i, s) for s, i in first.items())
    out = set()
    for k, (a, x) in enumerate(heads):
        for b, y in heads[k + 1 :]:
            shared, union = len(x & y), len(x | y)
            if shared * 100 >= union * percent:
                out.add((a, b, shared, union))
    return {i: first[frozenset(s)] for i, s in rows if s}, out


@pytest.mark.parametrize("percent, long", [(75, 1_000), (75, 3), (60, 3), (90, 2), (100, 1)])
def test_similar_groups_are_brute_force(spark, monkeypatch, percent, long):
    """With one hot feature, families of near sets, copies, tiny and empty sets, and many small blocks."""
    monkeypatch.setattr(near_duplicates, "LONG", long)
    monkeypatch.setattr(near_duplicates, "BLOCK_FEATURES", 300)
    rng = random.Random(percent * long)
    base = [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(4, 40))] for _ in range(6)]
    rows = []
    for i in range(220):
        own = set(rng.choice(base)) if rng.random() < 0.7 else {rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(0, 6))}
        for x in rng.sample(sorted(own), min(len(own), rng.randrange(5))):
            own.discard(x)
            if rng.random() < 0.5:
                own.add(rng.getrandbits(64) - (1 << 63))
        rows.append((i, own | {7} if own else own))
    rows += [(300 + i, rows[i][1]) for i in range(60)]
    who, pairs = near_duplicates.similar_groups(spark.createDataFrame([(i, sorted(s)) for i, s in rows], "id long, prints array<long>").repartition(3), percent)
    want, met = brute_pairs(rows, percent)
    assert {r.id: r.group for r in who.collect()} == want
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == met


def test_near_copies_by_the_score_are_verified_in_parts(spark, monkeypatch):
    """Sets made in the task from texts, in small parts of texts and of pairs, are those of prints; no group verifies all pairs of the one block."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [" ".join(base[: 110 + i % 8] + [f"x{i}"]) if i % 9 else None if i % 2 else "too short" for i in range(36)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    who, pairs = near_duplicates.similar_groups(near_duplicates.fingerprints(docs))
    want = {tuple(r) for r in pairs.collect()}, {tuple(r) for r in who.collect()}
    assert len(want[0]) > 300
    sizes = []
    monkeypatch.setattr(near_duplicates, "PAIRS_AT_ONCE", 40)
    monkeypatch.setattr(near_duplicates, "AT_ONCE", 500)
    kept = near_duplicates.checkpointed
    monkeypatch.setattr(near_duplicates, "checkpointed", lambda df: (out := kept(df), "part" in df.columns and sizes.extend(r["count"] for r in out.groupBy("p", "q", "part").count().collect()))[0])
    for got in (near_duplicates.text_groups(docs), near_duplicates.similar_groups(near_duplicates.fingerprints(docs))):
        assert ({tuple(r) for r in got[1].collect()}, {tuple(r) for r in got[0].collect()}) == want
    assert len(sizes) > 8 and max(sizes) < len(want[0]) / 2


def test_similar_groups_of_nothing(spark):
    none = spark.createDataFrame([(1, [])], "id long, prints array<long>")
    for df in (none, none.limit(0)):
        who, pairs = near_duplicates.similar_groups(df)
        assert who.count() == pairs.count() == 0
    judged = near_duplicates.gate(none.withColumn("junk", F.lit(True))).collect()
    assert [tuple(r) for r in judged] == [(1, "junk", None)]


def test_fingerprints_are_the_shingles(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "c", "d9", "é", "```", "[x](u)"], k=rng.randint(0, 30))) for _ in range(80)] + [None, "", "a " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.size(quality.shingle_texts(F.col("text"))).alias("n")).collect()}
    got = {r.id: r.prints for r in near_duplicates.fingerprints(docs).collect()}
    assert {i: len(p) for i, p in got.items()} == sizes
    named = {r.id: r.group for r in near_duplicates.equal_sets(docs).collect()}
    first = {}
    for i in sorted(got):
        first.setdefault(tuple(got[i]), i)
    assert named == {i: first[tuple(p)] for i, p in got.items() if p}  # one identity of sets


def test_sample_of_sets_stays_spread(spark):
    df = spark.range(0, 4000, 1, 4).select(F.col("id"))
    sample = near_duplicates._sampled(df, "id")
    assert sample.rdd.getNumPartitions() == 4 and sample.count() == 4000


def test_sets_that_share_one_passage_are_not_compared(spark, monkeypatch):
    """Sixty sets have a passage of eight features in common, two of them more."""
    rng = random.Random(5)
    draw = lambda n: [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    passage = draw(8)
    rows = [(i, draw(72) + passage) for i in range(60)]
    rows.append((60, rows[0][1][:70] + draw(4) + passage))
    listed = []
    candidates = near_duplicates._candidates
    monkeypatch.setattr(near_duplicates, "_order", lambda sample: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    monkeypatch.setattr(near_duplicates, "_candidates", lambda *a: (out := candidates(*a), listed.extend(map(tuple, out.collect())))[0])
    _, pairs = near_duplicates.similar_groups(spark.createDataFrame(rows, "id long, prints array<long>").repartition(3))
    assert [(r.a, r.b, r.shared, r.union) for r in pairs.collect()] == [(0, 60, 78, 84)]
    assert listed == [(0, 60)]


def test_near_copies_are_listed_once_a_pair(spark, monkeypatch):
    """Ninety near copies share about ninety features; their pairs are counted in blocks, in small parts, and not listed for each feature."""
    rng = random.Random(11)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(100)]
    rows = [(i, set(rng.sample(base, 90 + i % 9)) | {rng.getrandbits(64) - (1 << 63)}) for i in range(90)]
    rows += [(100 + i, {rng.getrandbits(64) - (1 << 63) for _ in range(8)} | set(base[:2])) for i in range(20)]
    monkeypatch.setattr(near_duplicates, "LONG", 10)
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 16, raising=False)
    monkeypatch.setattr(near_duplicates, "CELLS", 50, raising=False)
    monkeypatch.setattr(near_duplicates, "TURN_FEATURES", 3_000, raising=False)
    monkeypatch.setattr(near_duplicates, "MAP_BITS", 1 << 15, raising=False)
    listed = []
    for name in ("_met", "_met_often"):
        if met := getattr(near_duplicates, name, None):
            monkeypatch.setattr(near_duplicates, name, lambda *a, met=met: (out := met(*a), listed.append((out[0] if isinstance(out, tuple) else out).count()))[0])
    df = spark.createDataFrame([(i, sorted(s)) for i, s in rows], "id long, prints array<long>").repartition(3)
    _, pairs = near_duplicates.similar_groups(df)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 75)[1]
    assert len(got) > 3_000 and sum(listed) < 90 * 89


def test_phrases_are_found_in_one_pass():
    said = ["click here", "(use code)", "é10% off", "save up to 5 %", "don't miss out!", "win rate of 3%", "9 % weekly roi", "telegram channel"]
    unsaid = ["", "clickhere", "reuse codex", "a_10% off_", "learn mores", "click\u00a0here", "act  now"]
    got = quality.has_phrase(pa.array([*said, *unsaid, None])).to_pylist()
    assert got == [True] * len(said) + [False] * len(unsaid) + [None]


def test_marks_and_lines_measure_the_same_with_and_without_links(spark):
    """Marks go from the whole text where there are no links, line by line where there are."""
    prose = " ".join(f"Word{i}" for i in range(21))
    texts = [f"# H\n\n \t\n* {prose} \r\n*{prose}*\n***\n  \x0b\n> a `b`\n", f"{prose}\n \n{prose}", "\n \n", "***\n#\n", f"|{prose}|\x0c\n#  x\n####### y", "one two\n　\nthree"]
    docs = spark.createDataFrame([(i, t + end) for i, t in enumerate(texts) for end in ("", "\n[](")], "doc_id long, text string")
    got = {}
    for r in quality.measures(docs.withColumn("linked", F.col("text").contains("](")), "text").collect():
        got[r.doc_id, r.linked] = [r.headings, round(r.substantial_word_share * r.word_count), r.word_count, r.duplicate_line_share]
    for i in range(len(texts)):
        plain, linked = got[i, False], got[i, True]
        assert plain[0] == linked[0] and plain[1] == linked[1] and plain[2] == linked[2] - 1, (i, plain, linked)
    assert got[0, False] == [1, 42, 45, 0.0] and got[1, False][3] == 0.5 and got[2, False] == [0, 0, 0, 0.0]


def test_texts_are_counted_in_arrow_part_by_part(monkeypatch):
    """Against plain code, in parts of a few texts, with and without links; a text larger than a part, empty ones and none at all."""
    rng = random.Random(8)
    pool = ["a", "bb", "É", "日本", "#", "##", "*", "_x_", "|", "use code", "nation", "na", "tion"]
    spaces = [" ", "  ", "\t", "\n", "\n\n", " \n", "　", "﻿", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", rng.choice(spaces)]) for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["", "\n \n", "***", "# x\n" * 400]
    other = [rng.choice([None, rng.choice(texts)]) for _ in texts]
    terms = [rng.choice([[], ["nation"], ["nation", "use", "zz"]]) for _ in texts]
    white = f"[{quality.WS}]".replace(r"\x{", r"\u").replace("}", "")
    words = lambda x: [w for w in re.split(white, re.sub(r"[#>*_`|~]", " ", x)) if w]
    lines, by_text, matched = [], [], []
    for text, instead, some in zip(texts, other, terms):
        own = [y for x in text.split("\n") if (y := re.sub(f"{white}+", " ", x).strip(" "))]
        counts = [len(words(x)) for x in (text if instead is None else instead).split("\n")]
        lines.append({"lines": len(own), "distinct": len(set(own)), "headings": sum(bool(re.match("#{1,6} ", x)) for x in own), "substantial": sum(n for n in counts if n >= 20)})
        flat = " ".join(words(text if instead is None else instead))
        by_text.append({"words": len(flat.split(" ")) if flat else 0, "phrased": flat if re.search(r"\buse code\b", flat, re.A) else None})
        matched.append(sum(t in (text if instead is None else instead) for t in some))
    one, two, three = pa.array(texts), pa.array(other, pa.string()), pa.array(terms, pa.list_(pa.string()))
    sizes, cut = [], quality._lines
    monkeypatch.setattr(quality, "_lines", lambda x: (sizes.append(len(x)), cut(x))[1])
    for at_once in (300, 1 << 20):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        assert quality.line_measures(one, two).to_pylist() == lines
        assert quality.text_measures(one, two).to_pylist() == by_text
        assert quality.terms_matched(one, two, three).to_pylist() == matched
        assert max(sizes) < 60 if at_once == 300 else max(sizes) == len(texts)
    none = one.slice(0, 0), two.slice(0, 0)
    assert len(quality.line_measures(*none)) == len(quality.text_measures(*none)) == len(quality.terms_matched(*none, three.slice(0, 0))) == 0


def test_whole_texts_are_not_rewritten_by_expressions(spark):
    """Spark's replacing, splitting and trimming pass over a text at a high cost a byte, so texts are measured in one turn to Python, which only counts what is asked for."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    measured = quality.measures(df, "text", F.lit(registry.QUESTION))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(measured).count("ArrowEvalPython") == 1
    lines = plan(measured.select("doc_id", "duplicate_line_share"))
    assert "line_measures" in lines and "text_measures" not in lines and "terms_matched" not in lines
    # Of code, and of links line by line.
    assert " replace(" not in lines and "trim(" not in lines and lines.count("regexp_replace(") == 2 and lines.count("split(") == 1
