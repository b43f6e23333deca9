"""Markdown of threads, listings, channels, videos and repositories: a block per row, then one ordered collection per thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import demoted_headings, indented, normalised_body, text_of, truncated
from marginalia.functions.urls import absolute_permalink
from marginalia.operators import threads
from marginalia.operators.threads import author_label, comment_block, engagement, meta_line, number, points, utc_minute


def said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def blocks(rows: DataFrame, group: str, order: str, block: Column, between: str = "\n\n") -> DataFrame:
    """(group, body, n): the blocks of each group in order."""
    kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(kept, lambda x: x["b"]), between).alias("body"), F.count("*").alias("n"))


def line_if(test: Column, *parts) -> Column:
    return F.when(test, said(*parts)).otherwise("")


def lines(*parts: Column) -> Column:
    """The lines that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def reddit_threads(posts: DataFrame, comments: DataFrame, limit: int = 250, sort: str = "best") -> DataFrame:
    """(post_id, markdown) of posts with their live comments.

    ``posts``: post_id, title, subreddit, author, created_utc, score, num_comments, permalink, selftext.
    ``comments``: post_id, id, parent_id, pos, kind, author, body, score, score_hidden, created_utc, more_count.
    """
    c = F.col
    placed = threads.numbered_comments(comments, limit)
    own = comments.withColumn("id", c("id").cast("string")).join(placed, ["post_id", "id"])
    meta = meta_line(author_label(c("author")), points(c("score"), c("score_hidden")), utc_minute(c("created_utc")))
    body = blocks(own, "post_id", "ord", comment_block(c("path"), meta, c("body")))
    counts = threads.thread_counts(comments, limit)
    full = posts.join(counts, "post_id", "left").join(body, "post_id", "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    head = F.concat_ws(
        "\n", said("# ", F.coalesce(F.nullif(text_of("title"), F.lit("")), F.lit("Untitled Reddit post"))), F.lit(""), said("**Source:** Reddit — ", text_of("subreddit")), said("**Author:** ", author_label(c("author"))),
        said("**Posted:** ", utc_minute(c("created_utc"))), said("**Score:** ", points(c("score"), F.lit(False)), " · **Comments:** ", number(zero("num_comments"))), said("**Permalink:** ", absolute_permalink(text_of("permalink"))),
    )
    title = said("## Comments (", number(zero("rendered")), F.when(zero("deleted") > 0, said(", ", number(zero("deleted")), " deleted and dropped")).otherwise(""), f", sorted by {sort})")
    notes = F.concat_ws(
        " ", F.when(c("limit_reached"), said(f"Only the first {limit:,} comments were included (limit set in the options).")),
        F.when(zero("not_loaded") > 0, said(number(zero("not_loaded")), " further replies sit behind links that live under their own permalinks and were not fetched.")),
    )
    post = F.coalesce(F.nullif(normalised_body(c("selftext")), F.lit("")), F.lit("_No post body._"))
    parts = F.array(head, F.lit("## Post"), post, title, F.coalesce(F.nullif(F.col("body"), F.lit("")), F.lit("_No comments._")), F.when(notes != "", said("---\n> **Note:** ", notes)))
    return full.select("post_id", F.array_join(F.array_compact(parts), "\n\n").alias("markdown"))


def reddit_listing(entries: DataFrame, excerpt: int = 300) -> DataFrame:
    """(page_id, body, n) of listing entries: page_id, seq from 1, title, url, is_self, permalink, subreddit, author, score, num_comments, created_utc, selftext."""
    c = F.col
    link = absolute_permalink(text_of("permalink"))
    meta = meta_line(c("subreddit"), author_label(c("author")), points(c("score"), F.lit(False)), said(number(F.coalesce(c("num_comments"), F.lit(0))), " comments"), utc_minute(c("created_utc")))
    short = truncated(c("selftext"), excerpt)
    block = lines(
        said(c("seq").cast("string"), ". **[", text_of("title"), "](", F.when(c("is_self"), link).otherwise(text_of("url")), ")**"), said("   ", meta), line_if(~c("is_self") & (text_of("url") != ""), "   Link: ", text_of("url")),
        said("   Permalink: ", link), line_if(short != "", "   > ", short),
    )
    return blocks(entries, "page_id", "seq", block)


def x_threads(posts: DataFrame, root_id: Column) -> DataFrame:
    """(thread_id, markdown): what a post answers, the post with its continuation, and the replies.

    ``posts``: thread_id, seq, id, handle, name, date, url, text, replies, reposts, likes, views.
    """
    c = F.col
    placed = threads.thread_slice(posts, root_id)
    below = threads.self_thread(placed.where("place <> 'above'")).withColumn("section", F.when(c("place") == "root", 1).when(c("part") == "thread", 2).otherwise(3))
    rows = placed.where("place = 'above'").withColumns({"part": F.lit("thread"), "section": F.lit(0)}).unionByName(below)
    who = F.when(text_of("name") != "", said(text_of("name"), " (@", text_of("handle"), ")")).otherwise(said("@", text_of("handle")))
    text = F.coalesce(F.nullif(normalised_body(c("text")), F.lit("")), F.lit("_No readable post body._"))
    numbers = engagement(c("replies"), c("reposts"), c("likes"), c("views"))
    listed = said("- ", meta_line(said("**", who, "**"), c("date"), F.when(c("section") == 3, numbers), c("url")), "\n\n", indented(text, "  "))
    block = F.when(c("section") == 1, text).when(c("section") == 2, said("**Thread continued** — ", meta_line(c("date"), numbers), "\n\n", text)).otherwise(listed)
    bodies = F.array_sort(F.collect_list(F.struct("section", "seq", block.alias("b"))))
    of = lambda k: F.array_join(F.transform(F.filter("all", lambda x: x["section"] == k), lambda x: x["b"]), "\n\n")
    root = F.max(F.when(c("section") == 1, F.struct(text_of("text").alias("text"), who.alias("who"), c("date"), c("url"), numbers.alias("numbers"))))
    got = rows.groupBy("thread_id").agg(bodies.alias("all"), root.alias("r"), F.count_if(c("section") == 3).alias("n")).where("r IS NOT NULL")
    title = F.coalesce(F.nullif(truncated(c("r.text"), 100), F.lit("")), said("Post by ", c("r.who")))
    head = lines(said("# ", title, "\n"), F.lit("**Source:** X (Twitter)"), said("**Author:** ", c("r.who")), said("**Posted:** ", text_of("r.date")), said("**Link:** ", text_of("r.url")), line_if(c("r.numbers") != "", "**Engagement:** ", c("r.numbers")))
    above = F.when(of(0) != "", said("## In reply to\n\n", of(0)))
    parts = F.array(head, above, F.lit("## Post"), of(1), F.nullif(of(2), F.lit("")), said("## Replies (", number(c("n")), ")"), F.coalesce(F.nullif(of(3), F.lit("")), F.lit("_No replies were rendered on the page._")))
    return got.select("thread_id", F.array_join(F.array_compact(parts), "\n\n").alias("markdown"))


def channel_log(messages: DataFrame, source: str, own: str | None = None) -> DataFrame:
    """(channel_id, markdown) of chat messages: channel_id, seq, author, time, text, reply, attachments.

    Authors left blank are those of the message before; a quoted reply is cut to 160 characters.
    """
    c = F.col
    named = threads.carried_author(messages, "channel_id", "seq", own)
    who = F.coalesce(F.nullif(c("author"), F.lit("")), F.lit("[unknown]"))
    reply = F.when(F.char_length("reply") > 160, said(F.substring("reply", 1, 160), "…")).otherwise(text_of("reply"))
    body = F.coalesce(F.nullif(demoted_headings(text_of("text")), F.lit("")), F.lit("_[no text]_"))
    files = F.array_join(F.transform(F.slice(F.array_distinct(F.coalesce("attachments", F.array().cast("array<string>"))), 1, 6), lambda u: said("- Attachment: ", u)), "\n")
    block = said("**", meta_line(who, c("time")), "**", line_if(reply != "", "\n> replying to ", reply), "\n\n", body, line_if(files != "", "\n\n", files))
    got = blocks(named, "channel_id", "seq", block)
    head = said("# ", c("channel_id").cast("string"), f"\n\n**Source:** {source}\n**Messages:** ", number(c("n")))
    return got.select("channel_id", said(head, "\n\n## Transcript\n\n", c("body")).alias("markdown"))


def video_comments(comments: DataFrame, limit: int = 100) -> DataFrame:
    """(video_id, markdown, truncated) of comments (video_id, seq, level, author, likes, published, is_creator, body): paths are one or two deep."""
    c = F.col
    w = threads.Window.partitionBy("video_id").orderBy("seq").rowsBetween(threads.UNBOUNDED, 0)
    top = F.sum((c("level") == 0).cast("int")).over(w)
    step = threads.first_n(comments.withColumn("_top", top), "video_id", "seq", limit)
    reply = F.sum((c("level") > 0).cast("int")).over(threads.Window.partitionBy("video_id", "_top").orderBy("seq").rowsBetween(threads.UNBOUNDED, 0))
    path = F.when(c("level") == 0, c("_top").cast("string")).otherwise(said(F.greatest(c("_top"), F.lit(1)).cast("string"), ".", c("_r").cast("string")))
    meta = meta_line(F.coalesce(F.nullif(text_of("author"), F.lit("")), F.lit("[unknown]")), F.when(c("likes") > 0, said(c("likes").cast("string"), " likes")), c("published"), F.when(c("is_creator"), "[creator]"))
    block = said("**[", path, "]** ", meta, "\n\n", F.coalesce(F.nullif(demoted_headings(text_of("body")), F.lit("")), F.lit("_[empty]_")))
    got = blocks(step.withColumn("_r", reply), "video_id", "seq", block)
    flags = step.groupBy("video_id").agg(F.max("truncated").alias("truncated"))
    return got.join(flags, "video_id").select("video_id", said("## Comments (", number(c("n")), ")\n\n", c("body")).alias("markdown"), "truncated")


def repositories(repos: DataFrame, entries: DataFrame, limit: int = 1000) -> DataFrame:
    """(repo, markdown): header, facts and the drawn file tree of repositories (repo, description, language, stars, forks, license, url)."""
    c = F.col
    drawn = threads.drawn_tree(entries).where(c("ord") <= limit)
    tree = blocks(drawn, "repo", "ord", c("line"), "\n")
    counts = threads.tree_counts(entries)
    facts = meta_line(c("language"), said(number(F.coalesce(c("stars"), F.lit(0))), " stars"), said(number(F.coalesce(c("forks"), F.lit(0))), " forks"), c("license"))
    head = said("# ", c("repo"), line_if(text_of("description") != "", "\n\n", text_of("description")), "\n\n**Repository:** ", text_of("url"), "\n**Facts:** ", facts)
    full = repos.join(tree, "repo", "left").join(counts, "repo", "left")
    shown = said("## File tree\n\n", number(F.coalesce(c("files"), F.lit(0))), " files in ", number(F.coalesce(c("dirs"), F.lit(0))), " folders\n\n```\n", text_of("body"), "\n```")
    return full.select("repo", said(head, "\n\n", shown).alias("markdown"))
