"""Discovery: parse result pages, reject candidates with a reason, score, rank, hold reserves, promote.

A query's candidates are one group; the sequential rules about repeated hosts
and URLs are window functions over the candidates that pass the other rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import urls
from marginalia.functions.text import ascii_boundaries, collapsed, stripped_tags, text_of, trimmed

# Hosts behind walls, trusted hosts, words that carry no meaning, wording of time.
LOGIN_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "quora.com", "scribd.com", "coursehero.com", "chegg.com", "academia.edu", "researchgate.net")
PAYWALL_HOSTS = ("wsj.com", "ft.com", "bloomberg.com", "economist.com", "nytimes.com", "thetimes.co.uk", "seekingalpha.com", "medium.com")
TRUSTED_HOSTS = ("wikipedia.org", "developer.mozilla.org", "arxiv.org", "github.com", "stackoverflow.com")
PAYWALL_SNIPPET = r"(?i)sign in to continue|subscribe to read|create a free account"
TIME_SENSITIVE = r"(?i)\b(today|yesterday|latest|last (24 hours|day|week)|right now|current|breaking|this (week|month)|202[0-9])\b"
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "what", "when", "which", "while", "into", "about", "your", "their",
    "have", "has", "does", "how", "why", "are", "was", "were", "been", "best", "like",
)
COMFORTABLE = 5


def normalised_query(query: Column, most: int = 300) -> Column:
    return F.substring(collapsed(trimmed(text_of(query))), 1, most)


def clamped_limit(limit: Column, low: int = 5, high: int = 12, default: int = 8) -> Column:
    """A count from anything a number can be read from; null and '' read as 0, other text as the default."""
    raw = F.coalesce(F.trim(limit.cast("string")), F.lit(""))
    value = F.when(raw == "", 0.0).otherwise(raw.try_cast("double"))
    whole = F.floor(value + 0.5)
    return F.coalesce(F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.least(F.greatest(whole, F.lit(low)), F.lit(high))), F.lit(default)).cast("int")


def time_sensitive(query: Column) -> Column:
    return text_of(query).rlike(ascii_boundaries(TIME_SENSITIVE))


def request_url(endpoint: str, query: Column, region: bool = True) -> Column:
    encoded = F.url_encode(query)
    # Characters that the form encoding writes otherwise than the URL component encoding.
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return F.concat(F.lit(f"{endpoint}?q="), encoded, F.lit("&kl=wt-wt" if region else ""), F.when(time_sensitive(query), "&df=d").otherwise(""))


def content_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(text_of(query)), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))


def _attribute(tag: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, rf'(?i){name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(tag, rf"(?i){name}\s*=\s*'([^']*)'", 1))


def parse_results(pages: DataFrame) -> DataFrame:
    """(query_id, url, title, snippet, engine_rank) from result pages (query_id, html): blocks without advertisements.

    Ranks count the candidates kept. Pages without blocks give no rows.
    """
    opening = r"""(?i)(?=<div[^>]*class=["'][^"']*\bresults_links\b[^"']*["'][^>]*>)"""
    anchor = r"""(?is)(<a[^>]*class=["'][^"']*\bresult__a\b[^"']*["'][^>]*>)(.*?)</a>"""
    note = r"""(?is)<[a-z]+[^>]*class=["'][^"']*\bresult__snippet\b[^"']*["'][^>]*>(.*?)</[a-z]+>"""
    blocks = pages.select("query_id", F.posexplode(F.split(text_of("html"), opening)).alias("n", "block"))
    blocks = blocks.where(F.col("block").rlike(opening + "<") & ~F.col("block").rlike("result--ad|result--sponsored|badge--ad"))
    found = blocks.select(
        "query_id", "n",
        urls.unwrapped(_attribute(F.regexp_extract("block", anchor, 1), "href")).alias("url"),
        stripped_tags(F.regexp_extract("block", anchor, 2)).alias("title"),
        stripped_tags(F.regexp_extract("block", note, 1)).alias("snippet"),
    ).where("url IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("n"))
    return found.select("query_id", "url", "title", "snippet", rank.alias("engine_rank"))


def parse_lite_results(pages: DataFrame) -> DataFrame:
    """The same from the plain layout, whose links and snippets are two lists zipped by place before any is dropped."""
    link = r"""(?is)<a[^>]*class=["'][^"']*\bresult-link\b[^"']*["'][^>]*>.*?</a>"""
    note = r"""(?is)<td[^>]*class=["'][^"']*\bresult-snippet\b[^"']*["'][^>]*>(.*?)</td>"""
    both = F.arrays_zip(F.regexp_extract_all(text_of("html"), F.lit(link), F.lit(0)).alias("a"), F.regexp_extract_all(text_of("html"), F.lit(note), F.lit(1)).alias("s"))
    rows = pages.select("query_id", F.posexplode(both).alias("n", "z")).where("z.a IS NOT NULL")
    found = rows.select("query_id", "n", urls.unwrapped(_attribute(F.col("z.a"), "href")).alias("url"), stripped_tags(F.col("z.a")).alias("title"), stripped_tags(F.col("z.s")).alias("snippet")).where("url IS NOT NULL")
    return found.select("query_id", "url", "title", "snippet", F.row_number().over(Window.partitionBy("query_id").orderBy("n")).alias("engine_rank"))


def endpoint_outcome(status: Column, html: Column, n_results: Column) -> Column:
    """results, zero, drift, rate-limited or unreachable."""
    return (
        F.when(F.coalesce(status, F.lit(0)) != 200, "unreachable")
        .when(text_of(html).rlike("result--no-result"), "zero")
        .when(n_results > 0, "results")
        .when(text_of(html).rlike("(?i)anomaly|unusual traffic|please try again later"), "rate-limited")
        .otherwise("drift")
    )


def rejection(df: DataFrame) -> DataFrame:
    """Candidates with host, key, and the reason of the first rule that rejects each (null: it passes).

    The rules on repeats hold among the candidates that pass the others, in
    order of engine_rank (ties by url): the first of a host stays.
    """
    url = F.col("url")
    host, path, query = urls.host_of(url), urls.path_of(url), urls.query_of(url)
    social = host.isin("x.com", "twitter.com")
    web = urls.scheme_of(url).isin("http", "https") & (urls.hostname(url) != "")
    own = (
        F.when(~web, "Unsupported scheme")
        .when(urls.not_a_page(url), "Not a web page")
        .when(urls.host_in(host, LOGIN_HOSTS) | host.rlike(r"(^|\.)pinterest\.") | (social & ~path.rlike(r"/status/[0-9]+")), "Login wall")
        .when(urls.host_in(host, PAYWALL_HOSTS), "Paywalled")
        .when(F.concat_ws(" ", text_of("title"), text_of("snippet")).rlike(PAYWALL_SNIPPET), "Paywall notice in snippet")
    )
    step = df.withColumns({"host": host, "key": urls.dedup_key(url), "_own": own})
    w = Window.partitionBy("query_id", "host", F.col("_own").isNull()).orderBy("engine_rank", "url")
    step = step.withColumns({"_n": F.row_number().over(w), "_first": F.first("key").over(w)})
    repeat = F.when(F.col("_n") > 1, F.when(F.col("key") == F.col("_first"), "Duplicate URL").otherwise("Duplicate host"))
    return step.withColumn("reason", F.coalesce("_own", repeat)).drop("_own", "_n", "_first")


def score(url: Column, snippet: Column, query: Column, engine_rank: Column, seen: Column) -> Column:
    """20 less the rank; trust +6, two content words in the snippet +4, a deep path without query +3, lists -5, a known host -4."""
    host = urls.host_of(url)
    trusted = urls.host_in(host, TRUSTED_HOSTS) | host.rlike(r"\.(gov|edu|ac\.uk)\z|^docs\.")
    hay = F.lower(text_of(snippet))
    hits = F.size(F.array_distinct(F.filter(content_words(query), lambda w: F.contains(hay, w))))
    add = lambda test, points: F.when(test, points).otherwise(0)
    return (
        F.lit(20) - engine_rank + add(trusted, 6) + add(hits >= 2, 4) + add((urls.path_depth(url) >= 2) & (urls.clean_query(url) == ""), 3)
        - add(F.concat(urls.path_of(url), urls.clean_query(url)).rlike(urls.LOW_VALUE_PATH), 5) - add(seen, 4)
    ).cast("int")


def ranked(candidates: DataFrame, query: Column, limit: int = 8, history: DataFrame | None = None) -> DataFrame:
    """Every candidate with disposition (result, reserve, rejected), reason, score and place among the kept."""
    step = rejection(candidates)
    if history is None:
        step = step.withColumn("_seen", F.lit(False))
    else:
        step = step.join(history.select("host", F.lit(True).alias("_s")).distinct(), "host", "left").withColumn("_seen", F.coalesce("_s", F.lit(False))).drop("_s")
    kept = F.col("reason").isNull()
    step = step.withColumn("score", F.when(kept, score(F.col("url"), F.col("snippet"), query, F.col("engine_rank"), F.col("_seen"))))
    place = F.row_number().over(Window.partitionBy("query_id", kept).orderBy(F.desc("score"), "engine_rank", "url"))
    step = step.withColumn("pos", F.when(kept, place))
    clean = F.when(kept, urls.without_tracking("url")).otherwise(F.col("url"))
    disposition = F.when(~kept, "rejected").when(F.col("pos") <= max(5, min(12, limit)), "result").otherwise("reserve")
    return step.select("query_id", clean.alias("url"), "host", "title", "snippet", "engine_rank", disposition.alias("disposition"), "reason", "score", "pos")


def thin_note(n_results: Column, degraded: Column) -> Column:
    thin = F.when(n_results < COMFORTABLE, F.concat(F.lit("only "), n_results.cast("string"), F.lit(" usable sources after filtering")))
    return F.nullif(F.concat_ws("; ", degraded, thin), F.lit(""))


def promoted(outcomes: DataFrame, target: int) -> DataFrame:
    """Outcomes (query_id, pos, captured) with ``taken``: tried up to the place of the target-th success, and whether a reserve stood in.

    Places run over results and reserves in rank order; deadlines have no counterpart in a batch.
    """
    w = Window.partitionBy("query_id").orderBy("pos")
    done = F.coalesce(F.sum(F.col("captured").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = done < target
    return outcomes.withColumns({"attempted": tried, "taken": tried & F.col("captured"), "replacement": tried & (F.row_number().over(w) > target)})
