"""Host rules, chat sites, chat probe, Telegram kinds, limits."""

import random

from pyspark.sql import functions as F

from marginalia.operators import routing


def test_longest_rule_wins_by_either_join(spark, monkeypatch):
    rng = random.Random(8)
    names = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = [(n, rng.choice(["any", "exact", "below"]), rng.randrange(2)) for n in names[:25]] + [(names[0], "any", 0)] * 2
    rows = [(i, f"https://{n}:80/x") for i, n in enumerate(names)] + [(90, None), (91, "nonsense"), (92, "http:///x"), (93, "https://" + "a." * 200 + "a/")] + [(94, f"http://{names[0]}/")] * 3

    def best(host):
        met = [r for r in rules if (host == r[0] and r[1] != "below") or (host.endswith("." + r[0]) and r[1] != "exact")]
        return min(met, key=lambda r: (r[2], -len(r[0]), r[0]))[:3] if met else None

    want = sorted((i, best(u[8:-5]) if i < 90 else best(names[0]) if i == 94 else None) for i, u in rows)
    df = spark.createDataFrame(rows, "id int, url string").withColumns({"host": F.lit("h"), "salt": F.lit(1), "key": F.lit("k"), "rule": F.lit("old"), "row": F.lit(2)})
    for most in (100_000, 0):
        monkeypatch.setattr(routing, "BROADCAST_ROWS", most)
        out = routing.matched(df, spark.createDataFrame(rules, routing.RULES))
        assert sorted(out.columns) == sorted(df.columns)
        got = sorted(((r.id, tuple(r.rule) if r.rule else None) for r in out.collect()), key=lambda x: x[0])
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want):
            assert (g[1] is None) == (w[1] is None)
            if w[1]:  # rules of one suffix and priority tie
                assert (g[1][0], g[1][2]) == (w[1][0], w[1][2])
    assert routing.matched(df.limit(0), spark.createDataFrame(rules, routing.RULES)).count() == 0
    assert routing.matched(df, spark.createDataFrame([], routing.RULES)).where("rule IS NOT NULL").count() == 0


def test_chat_sites(spark):
    cases = {
        "https://claude.ai/chat/01234567-89ab-cdef-0123-456789abcdef": ("claude", True),
        "https://claude.ai/settings": ("claude", False),
        "https://notclaude.ai/chat/01234567-89ab-cdef-0123-456789abcdef": None,
        "https://ChatGPT.com/g/g-1/c/0123456789abcdef": ("chatgpt", True),
        "https://www.google.co.uk/search?q=a&udm=50": ("google-ai", True),
        "https://google.de/search?udm=5": ("google-ai", False),
        "https://google.com/search?udm&udm=50": ("google-ai", False),
        "https://google.info/search?udm=50": None,
        "https://gemini.google.com/app/1": ("google-ai", False),  # the earlier site claims the host
        "https://x.ai/c/1": ("grok", True),
        "https://chat.deepseek.com/a/chat/s/1": ("deepseek", True),
        "https://cursor.sh/agents": ("cursor", True),
        "http://localhost:3080/": ("openwebui", True),
        "http://a.localhost/": None,
        "http://[::1]:8080/x": ("openwebui", True),
        "http://box.local/": ("openwebui", True),
        "http://local/": None,
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "url string")
    got = {r.url: r.chat and (r.chat.site, r.chat.thread) for r in routing.chat_routed(df).collect()}
    assert got == {**cases, None: None}
    lazy = spark.createDataFrame([("https://poe.com/x",), ("https://m.poe.com/",), ("https://xpoe.com/",), (None,)], "url string")
    assert [r.lazy for r in routing.lazy_hosts(lazy).collect()] == ["host:poe.com", "host:poe.com", None, None]


def test_chat_probe(spark):
    pages = [(1, "https://claude.ai/chat/01234567-89ab-cdef-0123-456789abcdef"), (2, "https://x.ai/c/1"), (3, "https://x.ai/c/1"), (4, "https://forum.org/t"), (5, "https://forum.org/t"), (6, None)]
    said = [(2, 0, "user"), (3, 0, "user"), (3, 1, None)] + [(4, k, "user" if k == 1 else None) for k in range(4)] + [(5, k, ("user", "assistant")[k] if k < 2 else "tool") for k in range(4)]
    got = {r.conv_id: (r.site, r.label, r.turns, r.exchanges, r.is_chat) for r in routing.chat_probe(spark.createDataFrame(said, "conv_id long, turn int, role string"), spark.createDataFrame(pages, "conv_id long, url string")).collect()}
    assert got == {
        1: ("claude", "Claude", 0, 0, True), 2: ("grok", "Grok", 1, 1, False), 3: ("grok", "Grok", 2, 1, True), 4: (None, "forum.org", 4, 3, False),
        5: (None, "forum.org", 4, 2, True), 6: (None, "", 0, 0, False),
    }


def test_telegram_kinds(spark):
    rows = [("https://web.telegram.org/k/#-100_5", "9 members", "topic"), ("https://web.telegram.org/a/#-100", "9 Subscribers", "channel"), ("https://web.telegram.org/a/#-100", "12 УЧАСТНИКОВ", "group"), ("https://web.telegram.org/a/#@bot", None, "private"), ("https://web.telegram.org/a/", "x", None), ("https://t.me/#-1", "x", None), (None, None, None)]
    df = spark.createDataFrame(rows, "url string, status string, want string")
    assert df.where(~routing.telegram_kind("url", "status").eqNullSafe(F.col("want"))).count() == 0


def test_limits(spark):
    rows = [("all", None, None), ("0", None, 7), ("25", 25, 25), ("25abc", 25, 7), ("2.9", 2, 2), ("-3", 7, 7), ("", 7, 7), (None, 7, 7), ("1e2", 1, 100), ("NaN", 7, 7)]
    df = spark.createDataFrame(rows, "v string, zero int, other int")
    got = df.select("zero", "other", routing.limit_of(F.col("v"), "reddit", 7).alias("a"), routing.limit_of(F.col("v"), "github", 7).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(r.zero, r.other) for r in got]
