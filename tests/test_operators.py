"""URLs, discovery, classification, trees, sinks, code, HTML and streams."""

import zipfile

from pyspark.sql import functions as F

from marginalia.functions import text, urls
from marginalia.operators import classify, code, discovery, sinks, threads
from marginalia.sources import archives
from marginalia.operators.markdown import Options, convert, pages_to_markdown
from marginalia.streaming import gates


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text_helpers(spark):
    got = one(
        spark, text.decoded_entities(F.lit("a &amp; &#x41;&#66; &#xD800; &lt;b&gt; &nope;")), text.truncated(F.lit("one two three"), 9), text.inline_code(F.lit("a`b")),
        text.safe_inline(F.lit("a [b]\n*c*")), text.safe_target(F.lit("u (1)")), text.demoted_headings(F.lit("# a\nb")), text.normalised_body(F.lit(" a\r\n\n\n\nb ")), text.indented(F.lit("a\n\nb"), "  "),
    )
    assert got.c0 == "a & AB &#xD800; <b> &nope;" and got.c1 == "one two…" and got.c2 == "``a`b``" and got.c3 == r"a \[b\] \*c\*"
    assert got.c4 == "<u%20%281%29>" and got.c5 == "\\# a\nb" and got.c6 == "a\n\nb" and got.c7 == "  a\n\n  b"


def test_urls(spark):
    rows = ["https://www.A.com/x/?utm_source=f&b=1#t", "http://10.0.0.1/", "http://[::1]/", "ftp://a.com/", "nonsense", None, "http://host/", "https://8.8.8.8/"]
    df = spark.createDataFrame([(r,) for r in rows], "u string").select(urls.dedup_key("u").alias("k"), urls.private_reason("u").alias("p"), urls.without_tracking("u").alias("w"))
    got = df.collect()
    assert got[0].k == "a.com/x?b=1" and got[0].p is None and got[0].w == "https://www.a.com/x/?b=1#t"
    assert all("private" in got[i].p for i in (1, 2, 6)) and "ftp:" in got[3].p and "parsed" in got[4].p and got[5].p and got[7].p is None
    r = one(spark, urls.unwrapped(F.lit("/l/?uddg=https%3A%2F%2Fa.com%2F%2Bx&amp;rut=1")), urls.route(F.lit("https://x.com/u/status/1")), urls.route(F.lit("https://x.com/settings")), urls.route(F.lit("https://github.com/a/b")))
    assert r.c0 == "https://a.com/+x" and tuple(r.c1) == ("x", "post") and r.c2 is None and r.c3.site == "github"


def test_discovery(spark):
    html = '<div class="result results_links"><a class="result__a" href="/l/?uddg=https%3A%2F%2Fa.org%2Fp%2Fq">A &amp; B</a><a class="result__snippet">harbour bridge costs</a></div><div class="results_links result--ad"><a class="result__a" href="https://ad.com">x</a></div><div class="results_links"><a class="result__a" href="https://a.org/p/q/">again</a></div>'
    found = discovery.parse_results(spark.createDataFrame([(1, html)], "query_id int, html string"))
    assert [(r.url, r.title, r.engine_rank) for r in found.orderBy("engine_rank").collect()] == [("https://a.org/p/q", "A & B", 1), ("https://a.org/p/q/", "again", 2)]
    rows = [(1, u, "", "", i + 1) for i, u in enumerate(["https://a.org/p/q", "https://a.org/p/q/", "https://a.org/z", "https://wsj.com/x", "https://b.com/f.pdf", "mailto:x", "https://sub.facebook.com/"])]
    got = discovery.ranked(spark.createDataFrame(rows, "query_id int, url string, title string, snippet string, engine_rank int"), F.lit("harbour bridge"))
    by = {r.url: (r.disposition, r.reason) for r in got.collect()}
    assert by["https://a.org/p/q"] == ("result", None) and by["https://a.org/p/q/"][1] == "Duplicate URL" and by["https://a.org/z"][1] == "Duplicate host"
    assert by["https://wsj.com/x"][1] == "Paywalled" and by["https://b.com/f.pdf"][1] == "Not a web page" and by["mailto:x"][1] == "Unsupported scheme" and by["https://sub.facebook.com/"][1] == "Login wall"
    limits = one(spark, *[discovery.clamped_limit(F.lit(x)) for x in ("20", "x", None, "7.5")])
    assert (limits.c0, limits.c1, limits.c2, limits.c3) == (12, 8, 5, 8)


def test_responses(spark):
    ddl = "source_id int, attempt int, kind string, status int, requested_url string, final_url string, content_type string, body string, bytes long, message string"
    u = "https://a.com/x"
    rows = [
        (1, 1, None, None, u, u, None, None, None, None), (2, 1, "html", 200, u, u, "text/html", "<p>ok", 5, None), (3, 1, "httpError", 403, u, u, "text/html", "x" * 70000, 5, None),
        (3, 2, "httpError", 403, u, u, "text/html", "x" * 70000, 5, None), (4, 1, "html", 200, u, u, "text/html", "__cf_chl", 5, None), (5, 1, "html", 200, u, "https://a.com/login", "text/html", "x", 5, None),
        (6, 1, "text", 404, u, u, "text/plain", "x", 5, None), (7, 1, "nonHtml", 200, u, u, "application/pdf", "", 5, None), (8, 1, "tooLarge", 200, u, u, "text/html", "", 9, None),
    ]
    got = {(r.source_id, r.attempt): r.verdict for r in classify.classify_responses(spark.createDataFrame(rows, ddl)).collect()}
    decisions = {k: (v.decision, v.category) for k, v in got.items()}
    assert decisions[1, 1] == ("reject", "unusable") and decisions[2, 1] == ("use", None) and decisions[3, 1] == ("render", "transient") and decisions[3, 2] == ("reject", "wall")
    assert decisions[4, 1] == ("reject", "wall") and "Cloudflare" in got[4, 1].reason and decisions[5, 1] == ("render", "wall") and "/login" in got[5, 1].reason
    assert decisions[6, 1][0] == "reject" and got[7, 1].reason == classify.PDF and "(9 bytes)" in got[8, 1].reason


def test_comment_trees(spark):
    rows = [("p", "a", None, 0, "t1", "x"), ("p", "b", "a", 0, "t1", "[removed]"), ("p", "c", "b", 0, "t1", "y"), ("p", "d", "a", 1, "t1", "z"), ("p", "e", None, 1, "t1", ""), ("p", "f", "e", 0, "t1", "w"), ("p", "m", "a", 2, "more", None), ("p", "o", "nowhere", 0, "t1", "x")]
    df = spark.createDataFrame(rows, "post_id string, id string, parent_id string, pos int, kind string, body string")
    got = [(r.id, r.path) for r in threads.numbered_comments(df).orderBy("ord").collect()]
    assert got == [("a", "1"), ("c", "1.1"), ("d", "1.2"), ("f", "2")]
    assert threads.numbered_comments(df.limit(0)).count() == 0
    stream = spark.createDataFrame([("p", i, d, x) for i, (d, x) in enumerate([(0, False), (1, True), (2, False), (1, False), (0, True), (1, False)])], "post_id string, seq int, depth int, deleted boolean")
    assert [r.path for r in threads.stream_paths(stream).orderBy("seq").collect()] == ["1", None, "1.1", "1.2", None, "2"]


def test_branches_and_exchanges(spark):
    nodes = spark.createDataFrame([(1, "a", None, 1), (1, "b", "a", 2), (1, "c", "a", 3), (1, "d", "c", 4), (2, "x", "y", 1), (2, "y", "x", 2)], "conv_id int, node_id string, parent_id string, created_at int")
    got = threads.active_branch(nodes).collect()
    assert sorted((r.conv_id, r.depth, r.node_id) for r in got) == [(1, 0, "d"), (1, 1, "c"), (1, 2, "a"), (2, 0, "y"), (2, 1, "x")]
    talk = spark.createDataFrame([(1, i, r, r) for i, r in enumerate(["system", "assistant", "assistant", "user", "assistant", "user"])], "conv_id int, turn int, role string, text string")
    assert [r.exchange for r in threads.exchanges(talk).orderBy("turn").collect()] == [1, 2, 3, 3, 4]
    assert [r.turn for r in threads.last_exchanges(talk, 2).orderBy("turn").collect()] == [3, 4, 5]
    assert threads.transcript(talk).first().body.startswith("### Assistant\n\nassistant\n\n---\n\n")


def test_file_tree(spark):
    files = spark.createDataFrame([("r", "src/a.py", "blob", 3), ("r", "README", "blob", 1), ("r", "src/lib", "tree", None)], "repo string, path string, type string, size long")
    assert [r.line for r in threads.drawn_tree(files).orderBy("ord").collect()] == ["├── src/", "│   ├── lib/", "│   └── a.py", "└── README"]


def test_dates_and_counts(spark):
    now = F.lit("2024-02-01").cast("date")
    got = one(spark, threads.separator_date(F.lit("March 5"), now), threads.separator_date(F.lit("5 января 2023"), now), threads.separator_date(F.lit("yesterday"), now), threads.compact_count(F.lit("1.2K")), threads.duration(F.lit(3723)), threads.separator_date(F.lit("nothing"), now))
    assert [str(got[i]) for i in range(3)] == ["2023-03-05", "2023-01-05", "2024-01-31"] and (got.c3, got.c4, got.c5) == (1200, "1:02:03", None)


def test_sinks(spark, tmp_path):
    rows = [(1, 0, "A b", "m0", True), (1, 1, "A b", "m1", True), (1, 2, "A_b_1", "m2", True), (1, 3, "x", None, False)]
    df = spark.createDataFrame(rows, "batch int, pos int, title string, markdown string, success boolean")
    assert [r.name for r in sinks.unique_names(df, "batch", "pos").orderBy("pos").collect()] == ["A_b.md", "A_b_1.md", "A_b_1_1.md", "x.md"]
    assert sinks.merged(df, "batch", "pos").first().document == "m0\n\n---\n\nm1\n\n---\n\nm2"
    archives.write_archives(df, str(tmp_path / "z"), "batch", "pos")
    assert zipfile.ZipFile(tmp_path / "z" / "1.zip").namelist() == ["A_b.md", "A_b_1.md", "A_b_1_1.md"]
    assert sinks.tab_summary(df, "batch").first().message == "3 tabs (1 failed)"


def test_code(spark):
    snippet = "def f(x):\n    return x + 1\n"
    got = one(spark, code.looks_like_code(F.lit(snippet)), code.guess_language(F.lit(snippet)), code.looks_like_code(F.lit("A long sentence of prose.\nAnother one.")), code.dedented(F.lit("    a\n      b")), code.language_name(F.lit("py3")), code.guess_language(F.lit('{"a": 1}')))
    assert (got.c0, got.c1, got.c2, got.c3, got.c4, got.c5) == (True, "python", False, "a\n  b", "python", "json")


PAGE = (
    '<html><head><title>A page about bridges and harbours</title><meta name="author" content="N. N."></head><body><nav><a href="/">home</a></nav><article>'
    + "".join(f'<p>Paragraph {i}, with commas, and <b>bold</b> words and <a href="/x(1)">a link</a> that goes on for long enough to be scored.</p>' for i in range(8))
    + '<ul><li>one</li><li>two</li></ul><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table><pre><code class="language-py">a\n  b</code></pre></article><footer>foot</footer></body></html>'
)


def test_pages(spark):
    got = convert(PAGE, "https://e.com/a/b")
    assert got["markdown"].startswith("# A page about bridges and harbours\n\nParagraph 0, with commas, and **bold** words")
    for part in (r"[a link](https://e.com/x\(1\))", "-   one\n", "| A | B |\n| --- | --- |\n| 1 |  |", "```py\na\n  b\n```"):
        assert part in got["markdown"]
    assert "home" not in got["markdown"] and "foot" not in got["markdown"] and got["author"] == "N. N."
    assert "[a link]" not in convert(PAGE, "https://e.com/", Options(links=False))["markdown"]
    rows = [(1, "https://e.com/", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>" * 300 + "deep")]
    out = {r.page_id: r for r in pages_to_markdown(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 4 and out[1].text_length > 500 and out[3].body_text_length == 0


def test_open_formatting_carries_on():
    got = convert("<title>t</title><p><b>one<br><p>two", "https://e.com/", Options(scope="fullPage", title=False))
    assert got["markdown"].count("**") == 4


def test_streamed_gate(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[:50])), (2, " ".join(words[1:51]))], "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    more = spark.createDataFrame([(3, " ".join(words[2:52])), (4, "other words than those before in this text here")], "doc_id long, text string")
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for batch in (docs, more):
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        gates.gated(stream, out, lambda b: b.withColumn("junk", F.lit(False)), ckpt).awaitTermination(60)
    got = {r.id: (r.disposition, r.named) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("accepted", None), 2: ("duplicate", 1), 3: ("duplicate", 1), 4: ("accepted", None)}
