"""Routing of URLs by tables of host rules: chat sites, lists of hosts, lazily loaded pages.

A rule names a host suffix; it meets a host by a join on the suffixes of the
host's labels, so a table of a million rules costs a join and no chain of
conditions. Hosts are judged once each, however many rows they have.

Defined results: rows without a URL or host, and hosts beyond HOST_CHARS, meet
no rule; repeated rows are each judged; of several rules that fit, the smallest
priority wins, then the longest suffix, then the smallest suffix; rules that
repeat each other give one result; empty tables give no rule; a column of the
name of the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import urls
from marginalia.operators import threads
from marginalia.session import checkpointed

#: A host name is no longer than this.
HOST_CHARS = 253
#: Rows up to which a counted table of rules or judged hosts is broadcast.
BROADCAST_ROWS = 100_000
#: Tasks that share the rows of one frequent key where a table is not broadcast.
SALT = 16
RULES = "suffix string, fit string, priority int"
CHAT_RULES = f"{RULES}, site string, label string, thread string, param string, value string, reader boolean"

# The chat sites in their order. Hosts (``*``: two or three letters, ``*.*``: two or three, then two); which hosts fit
# (any: the host and those below it; exact: only the host; below: only those below); path of a conversation; parameter that tells it; whether a reader needs no turns.
CHAT_SITES = [
    ("claude", "Claude", ["claude.ai"], "any", r"(?i)^/chat/[0-9a-f-]{36}", None, None, True),
    ("chatgpt", "ChatGPT", ["chatgpt.com", "chat.openai.com"], "any", r"(?i)^/(c|g/[^/]+/c|share)/[0-9a-z-]{16,}", None, None, True),
    ("google-ai", "Google AI Mode", ["google.*", "google.*.*"], "any", r"(?i)^/search", "udm", "50", True),
    ("gemini", "Gemini", ["gemini.google.com"], "any", r"(?i)^/(app|share)/", None, None, False),
    ("grok", "Grok", ["grok.com", "x.ai"], "any", r"(?i)^/(chat|c|share)/", None, None, False),
    ("perplexity", "Perplexity", ["perplexity.ai"], "any", r"(?i)^/(search|page)/", None, None, False),
    ("deepseek", "DeepSeek", ["deepseek.com", "chat.deepseek.com"], "any", r"(?i)^/a/chat/", None, None, False),
    ("copilot", "Copilot", ["copilot.microsoft.com"], "any", r"(?i)^/(chats?|c)/", None, None, False),
    ("mistral", "Le Chat", ["chat.mistral.ai"], "any", r"(?i)^/chat/", None, None, False),
    ("cursor", "Cursor", ["cursor.com", "cursor.sh"], "any", r"(?i)^/(agents?|chat|dashboard)", None, None, False),
    ("openwebui", "Local chat", ["localhost", "127.0.0.1", "0.0.0.0", "[::1]"], "exact", "", None, None, False),
    ("openwebui", "Local chat", ["local"], "below", "", None, None, False),
]
# Hosts whose conversations load as they are scrolled.
LAZY_HOSTS = ("gemini.google.com", "aistudio.google.com", "chat.openai.com", "chatgpt.com", "claude.ai", "poe.com", "perplexity.ai", "copilot.microsoft.com")
# Sites that read a limit of 0 as none; the rest read it as the default.
ZERO_IS_ALL = ("reddit", "x", "chat")


def chat_rules(spark: SparkSession) -> DataFrame:
    """CHAT_SITES as a table of rules; sites earlier in the list win."""
    rows = [(suffix, fit, k, site, *rest) for k, (site, label, suffixes, fit, *more) in enumerate(CHAT_SITES) for suffix in suffixes for rest in [(label, *more)]]
    return spark.createDataFrame(rows, CHAT_RULES)


def host_list(spark: SparkSession, hosts) -> DataFrame:
    """A plain list of hosts as a table of rules: each fits itself and all below it, the longest wins."""
    return spark.createDataFrame([(h, "any", 0) for h in hosts], RULES)


def _suffixes(host: Column) -> Column:
    """(key, whole) of the host's label suffixes, with ``*`` for country and short endings."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    short, country = r"\.[a-z]{2,3}\z", r"\.[a-z]{2,3}\.[a-z]{2}\z"

    def keys(s):
        whole = (s == host).alias("whole")
        star = F.when(s.rlike(short), F.struct(F.regexp_replace(s, short, ".*").alias("key"), whole))
        stars = F.when(s.rlike(country), F.struct(F.regexp_replace(s, country, ".*.*").alias("key"), whole))
        return F.array(F.struct(s.alias("key"), whole), star, stars)

    return F.filter(F.flatten(F.transform(suffixes, keys)), lambda x: x.isNotNull())


def _met(rows: DataFrame, small: DataFrame, key: str, spread: Column, how: str) -> DataFrame:
    """``rows`` joined with ``small`` on ``key``: by broadcast if it is counted small; else with the rows of a frequent key dealt to SALT tasks."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    dealt = rows.withColumn("salt", F.pmod(spread, F.lit(SALT)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(copies, [key, "salt"], how).drop("salt")


def matched(df: DataFrame, rules: DataFrame, url: str = "url", into: str = "rule") -> DataFrame:
    """``df`` with the struct of the rule that its URL's host meets, null if none. ``rules`` has at least the columns of RULES."""
    rows = df.select(F.struct("*").alias("row"), urls.hostname(F.col(url)).alias("host"), F.xxhash64(F.col(url)).alias("spread"))
    hosts = rows.where(F.length("host").between(1, HOST_CHARS)).select("host").distinct()
    keyed = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("s")).select("host", "s.key", "s.whole")
    table = rules.select(F.col("suffix").alias("key"), F.struct("*").alias("rule"))
    fits = (F.col("rule.fit") == "any") | ((F.col("rule.fit") == "exact") & F.col("whole")) | ((F.col("rule.fit") == "below") & ~F.col("whole"))
    best = F.min_by("rule", F.struct(F.col("rule.priority"), -F.length("rule.suffix"), F.col("rule.suffix")))
    judged = checkpointed(_met(keyed, table, "key", F.xxhash64("host"), "inner").where(fits).groupBy("host").agg(best.alias("rule")))
    out = _met(rows, judged, "host", F.col("spread"), "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c != into], F.col("rule").alias(into))


def chat_routed(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``chat``: site, label, reader and whether the URL is that of a conversation (``thread``); null for other hosts."""
    found = matched(df, chat_rules(df.sparkSession), url, "chat")
    u, rule = F.col(url), F.col("chat")
    given = F.filter(F.split(F.substr(urls.query_of(u), F.lit(2)), "&"), lambda p: F.substring_index(p, "=", 1) == rule["param"])
    value = F.regexp_replace(F.get(given, F.lit(0)), "^[^=]*=?", "")
    thread = F.rlike(urls.path_of(u), rule["thread"]) & (rule["param"].isNull() | F.coalesce(value == rule["value"], F.lit(False)))
    chat = F.struct(rule["site"].alias("site"), rule["label"].alias("label"), rule["reader"].alias("reader"), thread.alias("thread"))
    return found.withColumn("chat", F.when(rule.isNotNull(), chat))


def lazy_hosts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``lazy``: ``host:`` and the listed host where the page loads as it is scrolled, else null."""
    return matched(df, host_list(df.sparkSession, LAZY_HOSTS), url, "lazy").withColumn("lazy", F.concat(F.lit("host:"), F.col("lazy.suffix")))


def chat_probe(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether each page (conv_id, url) holds a chat, by its site or by its turns (conv_id, turn, role).

    A conversation on a chat site is one if the site has a reader or two turns
    are seen; any page is one with four turns of which at least half say who
    speaks. Turns that do not say so alternate, the user first. Returns conv_id, site, label (the host elsewhere), turns, exchanges, is_chat;
    pages without messages have none.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    labelled = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    turns = messages.select("conv_id", labelled.alias("labelled"), "role", F.row_number().over(order).alias("turn"))
    spoken = F.when(F.col("labelled"), F.col("role")).when(F.col("turn") % 2 == 1, "user").otherwise("assistant")
    seen = threads.exchanges(turns.withColumn("role", spoken)).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if("labelled").alias("labelled"), F.max("exchange").alias("exchanges")
    )
    rows = chat_routed(pages.select("conv_id", "url")).join(seen, "conv_id", "left").fillna(0, ["turns", "labelled", "exchanges"])
    known = F.coalesce(F.col("chat.thread") & (F.col("chat.reader") | (F.col("turns") >= 2)), F.lit(False))
    talks = (F.col("turns") >= 4) & (2 * F.col("labelled") >= F.col("turns"))
    label = F.coalesce(F.col("chat.label"), urls.hostname(F.col("url")))
    return rows.select("conv_id", F.col("chat.site").alias("site"), label.alias("label"), F.col("turns").cast("long").alias("turns"), F.col("exchanges").cast("long").alias("exchanges"), (known | talks).alias("is_chat"))


def telegram_kind(url, status) -> Column:
    """topic, channel, group or private of a Telegram chat, by its fragment and the status line under its title; null for other pages."""
    place = urls.fragment_of(url)
    here = urls.hostname(url).rlike(r"(^|\.)web\.telegram\.org\z") & place.rlike(r"^#(-?[0-9]+(_[0-9]+)?|@[A-Za-z0-9_]+)")
    said = F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit(""))
    kind = (
        F.when(place.rlike(r"^#-?[0-9]+_[0-9]+"), "topic")
        .when(said.rlike(r"(?iu)subscriber|подписчи"), "channel")
        .when(said.rlike(r"(?iu)member|участник"), "group")
        .otherwise("private")
    )
    return F.when(here, kind)


def limit_of(value: Column, site: str, default: int | None) -> Column:
    """A limit as set for a site: null means no limit.

    ``all`` is none everywhere, 0 only on the sites of ZERO_IS_ALL, whose other values are read up to the first character that is no digit;
    the rest take whole numbers or decimals, rounded down. What is no positive number is ``default``.
    """
    said = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    if site in ZERO_IS_ALL:
        none, number = said.isin("all", "0"), F.regexp_extract(said, r"^\+?([0-9]+)", 1).try_cast("long")
    else:
        none, number = said == "all", F.floor(said.try_cast("double"))
        number = F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), number)
    return F.when(~none, F.when(number > 0, number).otherwise(F.lit(default).cast("long")))
