"""Quality measures, junk score with spoken reasons, and token accounting of Markdown texts.

Everything is a projection: no shuffle. Links and code are found by Spark's
expressions; words, lines, phrases and terms are counted in Arrow, whose passes
over a text are quicker. Thresholds, weights and sentences are fixed values of
the score.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import WS, ascii_boundaries, js_pattern, text_of, utf16_length, words_of
from marginalia.functions.urls import host_of

# Phrases of selling, of calls to action, of paid signals, of channels, and what makes a channel a pitch.
PROMO = (
    r"\baffiliate links?\b", r"\bwe (?:may )?earn (?:a )?commissions?\b", r"\bcommissions? (?:from|on) (?:qualifying )?purchases\b",
    r"\b(?:coupon|promo|discount|voucher) codes?\b", r"\buse code\b", r"\bcashback\b", r"\breferral (?:code|link)\b",
    r"\bbest price(?:s)? (?:online|today|guaranteed)\b", r"\blimited[- ]time offer\b", r"\bexclusive (?:offer|deal|bonus)\b",
    r"\bdeal of the (?:day|week)\b", r"\bsponsored (?:post|content|by)\b", r"\bsave up to \d+ ?%", r"\b\d+ ?% off\b",
    r"\bfree (?:shipping|trial|bonus)\b", r"\bmoney[- ]back guarantee\b", r"\brisk[- ]free\b", r"\bshop (?:now|the sale)\b",
    r"\bbuy (?:now|it now|on amazon)\b", r"\bcheck (?:the )?(?:latest )?price\b", r"\bview (?:deal|price)\b",
)
CTA = (
    r"\bclick here\b", r"\bsign up (?:now|today|free)\b", r"\bjoin (?:now|today|us now)\b", r"\bsubscribe (?:now|today)\b",
    r"\bregister (?:now|today)\b", r"\bdownload (?:now|the app)\b", r"\border now\b", r"\bget started (?:now|today|for free)\b",
    r"\bstart your free trial\b", r"\bbook a demo\b", r"\bcontact us today\b", r"\bclaim your\b", r"\bdon'?t miss out\b",
    r"\bact now\b", r"\blearn more\b", r"\bread more\b",
)
SIGNALS = (
    r"\bvip (?:channel|group|membership|signals?)\b", r"\b(?:premium|paid|private) signals?\b",
    r"\bguaranteed (?:profit|returns?|winnings?)\b", r"\bdouble your (?:money|investment|deposit)\b",
    r"\b\d+ ?% (?:daily|weekly|monthly) (?:profit|returns?|roi)\b", r"\bcopy trading (?:signals|room)\b",
    r"\binsider (?:picks|tips)\b", r"\bwin(?:ning)? rate of \d+ ?%",
)
CHANNELS = (r"\bsignals? (?:channel|group|provider)\b", r"\bjoin (?:our|my|the) telegram\b", r"\btelegram channel\b", r"\bwhatsapp group\b")
CUE = (
    r"\b(?:vip|paid|premium|subscribe|subscription|membership|members only|paying members|profits?|payouts?|roi|win rate|"
    r"deposit|guaranteed|sign ?up fee|per month|a month|free trial)\b|[$£€]\s?\d"
)
CUE_REACH = 120
AFFILIATE = r"(?i)([?&](?:tag|aff|affid|aff_id|ref|refid|utm_campaign|clickid|irclickid|awc)=)|(/(?:go|out|goto|recommends|deals?|redirect)/)"
QUERY_STOP = (
    "the", "and", "for", "with", "that", "this", "from", "what", "when", "which", "while", "into", "about", "your", "their",
    "have", "has", "does", "how", "why", "are", "was", "were", "been", "best", "like", "you", "can", "will", "its", "not",
    "but", "any", "all",
)
LINK = rf'\[([^\]]*)\]\(([^){WS}]*)(?:[{WS}]+"[^"]*")?\)'
FENCE = r"```(?s:.)*?(?:```|\z)"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
#: Insides of character classes: marks, and white space other than the space and line ends.
MARKS = r"#>*_`|~"
IN_LINE_SPACE = WS.replace(r"\n", "").replace(" ", "")
#: Bytes of text that are measured at once; a longer text is measured by itself.
AT_ONCE = 1 << 20
JUNK_SCORE = 100
DUPLICATE = 0.75
SHINGLE = 6
#: The order of the columns of ``measures``.
STATS = (
    "word_count", "link_count", "link_text_words", "affiliate_links", "outbound_links", "headings", "duplicate_line_share",
    "substantial_word_share", "link_text_share", "links_per_100_words", "promo_per_1000", "cta_per_1000", "signal_selling_hits",
    "channel_pitch_hits", "query_term_count", "query_terms_matched", "query_overlap",
)


def without_code(c: Column) -> Column:
    c = text_of(c)
    return F.when(c.contains("```"), F.regexp_replace(c, FENCE, " ")).otherwise(c)


def unlinked(c: Column) -> Column:
    """Links to their texts."""
    return F.when(c.contains("]("), F.regexp_replace(c, LINK, "$1")).otherwise(c)


def literal_of(pattern: str) -> str:
    """The longest text that every match of a pattern of PROMO, CTA, SIGNALS or CHANNELS holds."""
    pattern = re.sub(r"\(\?:[^()]*\)\??", "\0", pattern.replace(r"\b", ""))
    return max(re.sub(r"\[[^\]]*\]|\\d\+|.\?", "\0", pattern).split("\0"), key=len)


def has_phrase(texts: pa.Array) -> pa.Array:
    """Whether a text holds any of the phrases. Arrow's expressions pass over a text once for all patterns, where Java's try them one by one."""
    return pc.match_substring_regex(texts, "|".join(PROMO + CTA + SIGNALS + CHANNELS))


def _evened(texts: pa.Array, class_: str) -> pa.Array:
    """Runs of the class and of spaces to one space, without those at the edges. Single spaces are passed over, not replaced."""
    return pc.ascii_trim(pc.replace_substring_regex(texts, pattern=f"[ {class_}]{{2,}}|[{class_}]", replacement=" "), characters=" ")


def _words(evened: pa.Array) -> np.ndarray:
    """The number of words of each text, between which stand single spaces."""
    return np.where(pc.equal(evened, ""), 0, pc.add(pc.count_substring(evened, " "), 1))


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines that are not blank, evened, and the place of each one's text."""
    split = pc.split_pattern(texts, "\n")
    lines, at = _evened(split.flatten(), IN_LINE_SPACE), pc.list_parent_indices(split)
    some = pc.not_equal(lines, "")
    return lines.filter(some), at.filter(some).to_numpy()


def _by_parts(measured: Callable[..., pa.Array], texts: pa.Array, *more: pa.Array) -> pa.Array:
    """``measured`` of about ``AT_ONCE`` bytes of texts at a time, as each of its steps makes a copy."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([measured(*(x.slice(lo, hi - lo) for x in (texts, *more))) for lo, hi in zip(edges, edges[1:])])


def _line_measures(texts: pa.Array, unlinked_lines: pa.Array) -> pa.Array:
    lines, at = _lines(texts)
    coded = lines.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    distinct = np.unique(at * kinds + coded.indices.to_numpy()) // kinds
    heads = at[pc.match_substring_regex(lines, "^#{1,6} ").to_numpy(zero_copy_only=False)]
    # Words are those of lines without links, where there are any.
    linked = unlinked_lines.is_valid().to_numpy(zero_copy_only=False)
    other, of = _lines(unlinked_lines.drop_null())
    own = ~linked[at]
    words, of = _words(_evened(pa.concat_arrays([lines.filter(pa.array(own)), other]), MARKS)), np.concatenate([at[own], np.flatnonzero(linked)[of]])
    many = words >= 20
    counts = np.bincount(at, minlength=len(texts)), np.bincount(distinct, minlength=len(texts)), np.bincount(heads, minlength=len(texts)), np.bincount(of[many], words[many], len(texts))
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in counts], ["lines", "distinct", "headings", "substantial"])


def _text_measures(texts: pa.Array, plain: pa.Array) -> pa.Array:
    flat = _evened(pc.coalesce(plain, texts), rf"\n{IN_LINE_SPACE}{MARKS}")
    phrased = pc.if_else(has_phrase(flat), flat, pa.scalar(None, flat.type))
    return pa.StructArray.from_arrays([pa.array(_words(flat).astype(np.int32)), phrased], ["words", "phrased"])


def line_measures(texts: pa.Array, unlinked_lines: pa.Array) -> pa.Array:
    """Lines, distinct lines, headings, and words in lines of twenty or more. Where a text has links, the second text is the same without those within a line, else null."""
    return _by_parts(_line_measures, texts, unlinked_lines)


def text_measures(texts: pa.Array, plain: pa.Array) -> pa.Array:
    """Words, and the text as one line without marks where it holds a phrase, else null. ``plain`` is the text without links where it has some, else null."""
    return _by_parts(_text_measures, texts, plain)


def terms_matched(texts: pa.Array, plain: pa.Array, terms: pa.Array) -> pa.Array:
    """How many of the terms a text holds. They have neither marks nor white space in them, so the text need not be evened."""
    if not pc.any(pc.greater(pc.list_value_length(terms), 0)).as_py():
        return pa.array(np.zeros(len(texts), np.int32))
    sought, raw = terms.cast(pa.list_(pa.binary())), pc.coalesce(plain, texts).cast(pa.binary())
    return pa.array([sum(t in x.as_py() for t in some) for x, some in zip(raw, sought.to_pylist())], pa.int32())


def hits(c: Column, patterns) -> Column:
    """Non-overlapping matches of each pattern, summed. A pattern is only looked for where its literal part stands, as most texts have none."""
    return sum((F.when(c.contains(literal_of(p)), F.regexp_count(c, F.lit(ascii_boundaries(p)))).otherwise(0) for p in patterns), F.lit(0))


def hits_near(c: Column, patterns, cue: str, reach: int) -> Column:
    """Matches with the cue in a slice that reaches ``reach`` characters beyond either end."""
    cue = js_pattern(cue)

    def one(pattern):
        p = ascii_boundaries(pattern)
        zipped = F.arrays_zip(F.split(c, p).alias("t"), F.regexp_extract_all(c, F.lit(p), F.lit(0)).alias("m"))
        pieces = F.flatten(F.transform(zipped, lambda z: F.array(z["t"], F.coalesce(z["m"], F.lit("")))))

        def counts(all_pieces, k):
            before = F.array_join(F.slice(all_pieces, 1, 2 * k + 1), "")
            after = F.array_join(F.slice(all_pieces, 2 * k + 3, F.size(all_pieces)), "")
            window = F.concat(F.right(before, F.lit(reach)), F.get(all_pieces, 2 * k + 1), F.left(after, F.lit(reach)))
            return window.rlike(cue).cast("int")

        def total(all_pieces):
            at = F.sequence(F.lit(0), (F.size(all_pieces) / 2 - 2).cast("int"))
            return F.aggregate(F.transform(at, lambda k: counts(all_pieces, k)), F.lit(0), lambda a, x: a + x)

        return F.when(c.contains(literal_of(pattern)) & c.rlike(p), F.get(F.transform(F.array(pieces), total), F.lit(0))).otherwise(0)

    return sum((one(p) for p in patterns), F.lit(0))


def query_terms(query: Column) -> Column:
    kept = F.regexp_replace(F.lower(text_of(query)), rf"[^a-z0-9{WS}-]", " ")
    return F.array_distinct(F.filter(F.split(kept, f"[{WS}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*QUERY_STOP)))


def measures(df: DataFrame, markdown: str = "markdown", query: Column | None = None, url: Column | None = None) -> DataFrame:
    """``df`` with the columns STATS. Null and empty texts measure 0 everywhere."""
    query = F.lit("") if query is None else query
    step = df.withColumns({"_raw": without_code(text_of(markdown)), "_terms": query_terms(query), "_host": host_of(F.lit("") if url is None else url)})
    step = step.withColumns({"_linked": F.col("_raw").contains("]("), "_small": F.lower("_raw")})
    linked = lambda part: F.when(F.col("_linked"), F.regexp_extract_all("_raw", F.lit(LINK), F.lit(part))).otherwise(F.array().cast("array<string>"))
    step = step.withColumns(
        {
            "_targets": linked(2),
            "_texts": linked(1),
            "_plain": F.when(F.col("_linked"), F.regexp_replace(unlinked(F.col("_small")), IMAGE, " ")),
            # Line by line, as a link may reach over lines.
            "_unlinked": F.when(F.col("_linked"), F.array_join(F.transform(F.split("_small", "\n"), unlinked), "\n")),
        }
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    step = step.withColumns(
        {
            "link_count": F.size("_targets"),
            "link_text_words": total(F.transform("_texts", lambda x: F.size(words_of(x)))),
            "affiliate_links": F.size(F.filter("_targets", lambda x: x.rlike(AFFILIATE))),
            "outbound_links": F.size(F.filter(F.transform("_targets", host_of), lambda h: (h != "") & (F.col("_host") != "") & (h != F.col("_host")))),
            "query_term_count": F.size("_terms"),
        }
    )
    # Three, so that a query that needs one leaves out the others; the texts go to Python once.
    step = step.withColumns(
        {
            "_by_line": F.arrow_udf(line_measures, "lines int, distinct int, headings int, substantial int")("_small", "_unlinked"),
            "_by_text": F.arrow_udf(text_measures, "words int, phrased string")("_small", "_plain"),
            "query_terms_matched": F.arrow_udf(terms_matched, "int")("_small", "_plain", "_terms"),
        }
    )
    lines, n, phrased = F.col("_by_line.lines"), F.col("_by_text.words"), F.col("_by_text.phrased")
    found = lambda counted: F.when(phrased.isNotNull(), counted).otherwise(0)
    step = step.withColumns(
        {
            "word_count": n,
            "headings": F.col("_by_line.headings"),
            "duplicate_line_share": F.when(lines > 0, (lines - F.col("_by_line.distinct")) / lines).otherwise(0.0),
            "_promo": found(hits(phrased, PROMO)),
            "_cta": found(hits(phrased, CTA)),
            "signal_selling_hits": found(hits(phrased, SIGNALS)),
            "channel_pitch_hits": found(hits_near(phrased, CHANNELS, CUE, CUE_REACH)),
        }
    )
    share = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    step = step.withColumns(
        {
            "substantial_word_share": share(F.col("_by_line.substantial"), n),
            "link_text_share": share(F.col("link_text_words"), n),
            "links_per_100_words": share(F.col("link_count") * 100, n),
            "promo_per_1000": F.col("_promo") * share(F.lit(1000), n),
            "cta_per_1000": F.col("_cta") * share(F.lit(1000), n),
            "query_overlap": F.when(F.col("query_term_count") > 0, F.col("query_terms_matched") / F.col("query_term_count")).otherwise(1.0),
        }
    )
    return step.select(*[c for c in df.columns if c not in STATS], *STATS)


def _ladder(value: Column, steps, text) -> Column:
    """The first (bound, points) that the value reaches, with its sentence."""
    out = F.lit(None).cast("struct<points:int,text:string>")
    for bound, points in reversed(steps):
        out = F.when(value >= bound, F.struct(F.lit(points).alias("points"), text.alias("text"))).otherwise(out)
    return out


def reasons() -> Column:
    """Measured reasons in order: array of (points, ord, text)."""
    c = F.col
    fixed = lambda x: F.format_string("%.1f", x)
    percent = lambda x: F.floor(x * 100 + 0.5).cast("string")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    one = lambda test, points, text: F.when(test, F.struct(F.lit(points).alias("points"), text.alias("text")))
    num = lambda name: c(name).cast("string")
    words, prose = c("word_count"), c("substantial_word_share")
    groups = [
        F.coalesce(one(c("signal_selling_hits") >= 2, 100, said(num("signal_selling_hits"), " paid-signal or VIP-channel pitches")), one(c("signal_selling_hits") == 1, 30, said("a paid-signal or VIP-channel pitch"))),
        F.coalesce(one(c("channel_pitch_hits") >= 2, 40, said(num("channel_pitch_hits"), " paid chat-channel pitches")), one(c("channel_pitch_hits") == 1, 20, said("a paid chat-channel pitch"))),
        _ladder(c("promo_per_1000"), ((10, 70), (6, 50), (3, 30), (1.5, 12)), said(fixed(c("promo_per_1000")), " promotional phrases per 1000 words")),
        _ladder(c("cta_per_1000"), ((6, 30), (3, 15)), said(fixed(c("cta_per_1000")), " calls to action per 1000 words")),
        _ladder(c("link_text_share"), ((0.5, 45), (0.35, 25), (0.25, 10)), said(percent(c("link_text_share")), "% of the text is link text")),
        _ladder(c("links_per_100_words"), ((12, 20),), said(fixed(c("links_per_100_words")), " links per 100 words")),
        _ladder(c("affiliate_links"), ((10, 40), (5, 25), (3, 10)), said(num("affiliate_links"), " affiliate-shaped links")),
        _ladder(c("duplicate_line_share"), ((0.3, 20),), said(percent(c("duplicate_line_share")), "% of the lines are repeats")),
        F.coalesce(one((words >= 120) & (prose < 0.2), 25, said("almost none of the page is written in paragraphs")), one((words >= 120) & (prose < 0.4), 10, said("only ", percent(prose), "% of the page is written in paragraphs"))),
        F.coalesce(one(words < 90, 35, said("only ", num("word_count"), " words of content")), one(words < 220, 20, said("only ", num("word_count"), " words of content"))),
        one((c("headings") >= 6) & (words / F.greatest(c("headings"), F.lit(1)) < 35), 15, said(num("headings"), " headings with almost nothing under them")),
        F.coalesce(
            one((c("query_term_count") > 0) & (c("query_terms_matched") == 0), 30, said("none of the question's terms appear on the page")),
            one((c("query_term_count") > 0) & (c("query_overlap") < 0.25), 10, said("only ", num("query_terms_matched"), " of ", num("query_term_count"), " question terms appear on the page")),
        ),
        one((c("query_term_count") >= 2) & (c("query_terms_matched") == 0) & (words >= 120) & (prose < 0.4), 100, said("the page is about something else and is a list of links rather than prose")),
    ]
    listed = F.transform(F.array(*groups), lambda g, i: F.when(g.isNotNull(), F.struct(g["points"].alias("points"), i.alias("ord"), g["text"].alias("text"))))
    return F.array_compact(listed)


def scored(measured: DataFrame) -> DataFrame:
    """``measured`` with reasons, score, verdict, category and the spoken reason."""
    step = measured.withColumn("reasons", reasons())
    step = step.withColumn("score", F.aggregate("reasons", F.lit(0), lambda s, r: s + r["points"]))
    heaviest = F.transform(F.array_sort(F.transform("reasons", lambda r: F.struct((-r["points"]).alias("p"), r["ord"].alias("o"), r["text"].alias("t")))), lambda r: r["t"])
    junk = F.col("score") >= JUNK_SCORE
    spoken = F.concat(F.lit("Dropped as low-value: "), F.array_join(F.slice(heaviest, 1, 2), " and "))
    return step.withColumns({"verdict": F.when(junk, "reject").otherwise("keep"), "category": F.when(junk, "junk"), "reason": F.when(junk, spoken)})


def shingle_source(c: Column) -> Column:
    """The text whose runs of a-z0-9 are the words of shingles: code and link targets are out, letters lower."""
    return F.lower(unlinked(without_code(c)))


def shingle_texts(c: Column, size: int = SHINGLE) -> Column:
    """Distinct shingles of the words left when code, link targets and other than a-z0-9 are out."""
    plain = F.regexp_replace(shingle_source(c), rf"[^a-z0-9{WS}]", " ")
    # Bound to a lambda variable, the words are split once and not once a shingle.
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    each = F.transform(F.array(words_of(plain)), lambda w: F.when(F.size(w) >= size, F.array_distinct(cut(w))).otherwise(F.array().cast("array<string>")))
    return F.get(each, F.lit(0))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII string."""
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def fingerprint(c: Column) -> Column:
    return F.array_distinct(F.transform(shingle_texts(c), fnv1a))


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def token_estimate(c: Column) -> Column:
    """The larger of three quarters of the words and a quarter of the characters, rounded up."""
    t = text_of(c)
    return F.ceil(F.greatest(F.size(words_of(t)) * 0.75, utf16_length(t) / 4)).cast("int")


#: Fixed value: how a text falls into pieces before tokens are estimated.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+|[" + WS + r"]+(?![^" + WS + r"])|[" + WS + "]+"


def token_heuristic(c: Column) -> Column:
    """A token for every four UTF-8 bytes of each piece, one at least, and one more; 0 for nothing."""
    pieces = F.regexp_extract_all(text_of(c), F.lit(PIECES), F.lit(0))
    each = F.transform(pieces, lambda p: F.greatest(F.lit(1), F.ceil(F.octet_length(p) / 4).cast("int")))
    return F.when(text_of(c) == "", 0).otherwise(F.aggregate(each, F.lit(1), lambda s, n: s + n))


def limit_report(count: Column, limit: int) -> Column:
    percent = F.floor(count * 1000 / limit + 0.5) / 10
    return F.struct(
        count.alias("count"), F.lit(limit).alias("limit"), percent.alias("percentage"), (count > limit).alias("is_over_limit"),
        F.greatest(F.lit(0), limit - count).alias("remaining"),
    )


def token_label(count: Column, limit: int | None = None) -> Column:
    if limit:
        share = F.floor(count * 100 / limit + 0.5).cast("string")
        return F.concat(F.format_number(count, 0), F.lit(f" / {limit:,} tokens ("), share, F.lit("%)"))
    return F.concat(F.format_number(count, 0), F.lit(" tokens"))


def ranked_tokens(df: DataFrame, text: str, ranks: dict[bytes, int], name: str = "tokens") -> DataFrame:
    """Tokens by the highest-ranked entry of at most 32 bytes at each place; a byte that begins none is one.

    ``ranks`` is a vocabulary of fixed size and is broadcast. Null and empty texts have none.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("int")
    def count(texts):
        known = shared.value

        def one(text):
            data, i, n = (text or "").encode(), 0, 0
            while i < len(data):
                best = max((known.get(data[i : i + k], -1), -k) for k in range(1, min(32, len(data) - i) + 1))
                i += -best[1] if best[0] >= 0 else 1
                n += 1
            return n

        return texts.map(one, na_action=None).astype("int32")

    return df.withColumn(name, count(F.col(text)))


def token_short(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) == 0, "0 tok").when(count >= 1000, F.concat(F.format_string("%.1f", count / 1000), F.lit("k tok"))).otherwise(F.concat(count.cast("string"), F.lit(" tok")))


def delivery(tokens: Column, limit: int = 128_000) -> Column:
    return F.when(tokens > limit, "file").otherwise("clipboard")
