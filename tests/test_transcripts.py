"""Site payloads and the Markdown of threads, channels, videos and repositories."""

from pyspark.sql import functions as F

from marginalia.operators import transcripts
from marginalia.sources import site_payloads


def test_payloads(spark, tmp_path):
    page = 'x var ytInitialData = {"a": {"b": "}\\"{"}, "c": 1}; "KEY":"v1" "KEY":"v2"'
    df = spark.createDataFrame([(page,), ("ytInitialData = {broken",), (None,)], "html string")
    got = [r.payload for r in site_payloads.embedded_json(df, "html", "ytInitialData").collect()]
    assert got == ['{"a": {"b": "}\\"{"}, "c": 1}', None, None]
    r = df.limit(1).select(site_payloads.config_value(F.col("html"), "KEY").alias("k"), site_payloads.base64_text(F.lit("aMOp\nbGw=")).alias("b")).first()
    assert (r.k, r.b) == ("v1", "héll")
    (tmp_path / "t.json").write_text('{"repo": "r", "tree": [{"path": "a/b", "type": "blob", "size": 3}]}\n')
    assert site_payloads.read_trees(spark, str(tmp_path / "t.json")).first().path == "a/b"


def test_reddit_thread(spark):
    posts = spark.createDataFrame([("p", "T", "r/x", "me", 0, 1, 2, "/r/x/p", "body")], "post_id string, title string, subreddit string, author string, created_utc long, score int, num_comments int, permalink string, selftext string")
    rows = [("p", "a", None, 0, "t1", "u", "# hi", 5, False, 60, None), ("p", "b", "a", 0, "t1", "v", "[deleted]", 1, False, 60, None), ("p", "m", "a", 1, "more", None, None, None, None, None, 7)]
    comments = spark.createDataFrame(rows, "post_id string, id string, parent_id string, pos int, kind string, author string, body string, score int, score_hidden boolean, created_utc long, more_count int")
    got = transcripts.reddit_threads(posts, comments).first().markdown
    assert "**[1]** u/u · 5 points · 1970-01-01 00:01 UTC\n\n\\# hi" in got and "## Comments (1, 1 deleted and dropped, sorted by best)" in got and "7 further replies" in got


def test_other_sites(spark):
    log = spark.createDataFrame([("c", 1, "ann", "10:00", "hello", None, ["u"]), ("c", 2, "", "10:01", "", "ann: " + "x" * 200, None)], "channel_id string, seq int, author string, time string, text string, reply string, attachments array<string>")
    got = transcripts.channel_log(log, "Discord").first().markdown
    assert "**ann · 10:00**\n\nhello\n\n- Attachment: u" in got and "**ann · 10:01**\n> replying to ann: xx" in got and "…" in got and "_[no text]_" in got
    video = spark.createDataFrame([("v", 1, 0, "a", 3, "1 day", True, "top"), ("v", 2, 1, "b", 0, None, False, "reply"), ("v", 3, 0, None, 0, None, False, "")], "video_id string, seq int, level int, author string, likes int, published string, is_creator boolean, body string")
    got = transcripts.video_comments(video).first().markdown
    assert "**[1]** a · 3 likes · 1 day · [creator]\n\ntop" in got and "**[1.1]** b\n\nreply" in got and "**[2]** [unknown]\n\n_[empty]_" in got
    posts = spark.createDataFrame([("t", i, str(i), h, "", "d", "u", f"text {i}", None, None, i, None) for i, h in enumerate(["z", "a", "a", "b"])], "thread_id string, seq int, id string, handle string, name string, date string, url string, text string, replies int, reposts int, likes int, views int")
    got = transcripts.x_threads(posts, F.lit("1")).first().markdown
    assert "## In reply to\n\n- **@z** · d · u\n\n  text 0" in got and "**Thread continued** — d · 2 likes\n\ntext 2" in got and "## Replies (1)" in got
    repos = spark.createDataFrame([("r", "about", "Go", 1200, 3, "MIT", "u")], "repo string, description string, language string, stars int, forks int, license string, url string")
    files = spark.createDataFrame([("r", "a/b", "blob", 1)], "repo string, path string, type string, size long")
    got = transcripts.repositories(repos, files).first().markdown
    assert "**Facts:** Go · 1,200 stars · 3 forks · MIT" in got and "├" not in got and "└── a/\n    └── b" in got
