"""Trees and sequences: comment trees, active branches, exchanges, self-threads, file trees, message streams.

Trees are walked by joins, so a thread of any size stays distributed: branches
and comment paths double their reach with every round, so a chain of n messages
takes about log2(n) of them; sequences are window functions. Only the
depth-coded stream of one page (bounded by the page) is folded in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import demoted_headings, normalised_body, text_of
from marginalia.session import checkpointed, dropped

UNBOUNDED = Window.unboundedPreceding


def meta_line(*parts: Column) -> Column:
    """The parts that are neither null nor empty, joined with middle dots."""
    return F.array_join(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull() & (x != "")), " · ")


def number(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def points(score: Column, hidden: Column) -> Column:
    unit = F.when(F.abs(score) == 1, " point").otherwise(" points")
    return F.when(F.coalesce(hidden, F.lit(False)), "score hidden").when(score.isNull(), "score unknown").otherwise(F.concat(number(score), unit))


def utc_minute(seconds: Column) -> Column:
    """Epoch seconds as YYYY-MM-DD HH:MM UTC; '' for none (the session's zone is UTC)."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"), F.lit(" UTC")))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def compact_count(text: Column) -> Column:
    """1.2K, 3M, 1B and plain numbers; null if it is no count."""
    clean = F.replace(F.upper(F.trim(text)), F.lit(","), F.lit(""))
    value = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMB]?)\z", 1).try_cast("double")
    scale = F.create_map(*[F.lit(x) for x in ("", 1, "K", 1_000, "M", 1_000_000, "B", 1_000_000_000)])
    return F.floor(value * F.element_at(scale, F.regexp_extract(clean, r"([KMB]?)\z", 1)) + 0.5).cast("long")


def author_label(author: Column) -> Column:
    return F.when(text_of(author).isin("", "[deleted]"), "[deleted]").otherwise(F.concat(F.lit("u/"), author))


def badges(flags: dict[str, Column]) -> Column:
    """Named flags that hold, in order, as ``[a, b]``, or ''."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags.items()]))
    return F.when(F.size(held) > 0, F.concat(F.lit("["), F.array_join(held, ", "), F.lit("]"))).otherwise("")


def is_deleted(body: Column) -> Column:
    return text_of(body).isin("", "[removed]", "[deleted]")


def is_deleted_label(author: Column) -> Column:
    return F.trim(text_of(author)).rlike(r"^\[.+\]\z")


def _descend(roots: DataFrame, step) -> DataFrame:
    """Union of ``roots`` and what ``step`` makes of each level, until a level is empty."""
    level, out = checkpointed(roots), None
    while True:
        out = level if out is None else out.unionByName(level)
        level = checkpointed(step(level))
        if level.isEmpty():
            return out


def _doubled(nodes: DataFrame, group: str, fold: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``nodes`` with the columns of ``fold`` gathered from each node up to its root.

    ``nodes``: ``group``, id, up (null for a root), and the columns. A column's
    function takes a node's value and the value above it. Every round a node takes
    over its upper node's pointer, so a chain of n nodes takes log2(n) rounds; nodes
    below an unknown id, and on or below a cycle, go. The result is a checkpoint.
    """
    most = nodes.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    table = checkpointed(nodes)
    for _ in range(int(most).bit_length() + 1):
        if table.where("up IS NOT NULL").isEmpty():
            break
        above = table.select(group, F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in fold])
        moved = table.where("up IS NOT NULL").join(above, [group, "up"])
        moved = moved.select(*[F.col("_up").alias("up") if c == "up" else fold[c](F.col(c), F.col(f"_{c}")).alias(c) if c in fold else F.col(c) for c in table.columns])
        new = checkpointed(table.where("up IS NULL").unionByName(moved))
        dropped(table)
        table = new
    return table.where("up IS NULL")  # who still points somewhere is on a cycle


def numbered_comments(comments: DataFrame, limit: int | None = None) -> DataFrame:
    """Live comments with ``path`` (1, 1.1, ...) and ``ord`` in depth-first order.

    Needs post_id, id, parent_id (null for roots), pos, kind and body. Deleted
    comments go and their replies rise into their place; ``more`` nodes take no
    number; comments whose parent is unknown go, and cycles. With ``limit``, only the
    first so many in that order stay. Repeated ids: the first place counts.
    """
    first = F.row_number().over(Window.partitionBy("post_id", "id").orderBy("pos"))
    base = comments.withColumn("_r", first).where(F.col("_r") == 1).drop("_r").where("kind = 't1'")
    text = lambda c: F.col(c).cast("string")
    base = checkpointed(base.select("post_id", text("id").alias("id"), text("parent_id").alias("up"), F.lpad(text("pos"), 9, "0").alias("sort"), is_deleted(F.col("body")).alias("gone")))
    # Of each comment the nearest live one above it, and the places from the top, which sort in depth-first order.
    alive = base.select("post_id", F.col("id").alias("up"), F.when(~F.col("gone"), F.col("id")).alias("live"))
    lifted = _doubled(
        base.join(alive, ["post_id", "up"], "left").select("post_id", "id", "up", "sort", "live", "gone"), "post_id",
        {"sort": lambda own, above: F.concat_ws(".", above, own), "live": lambda own, above: F.coalesce(own, above)},
    )
    place = F.row_number().over(Window.partitionBy("post_id", "live").orderBy("sort"))
    live = lifted.where("NOT gone").withColumns({"path": place.cast("string"), "ord": F.row_number().over(Window.partitionBy("post_id").orderBy("sort"))})
    out = _doubled(live.select("post_id", "id", F.col("live").alias("up"), "path", "ord"), "post_id", {"path": lambda own, above: F.concat_ws(".", above, own)})
    dropped(base)
    out = out.select("post_id", "id", "path", "ord")
    return out.where(F.col("ord") <= limit) if limit else out


def thread_counts(comments: DataFrame, limit: int) -> DataFrame:
    """rendered, deleted, not_loaded and limit_reached of each post."""
    live = numbered_comments(comments).groupBy("post_id").agg(F.count("*").alias("n"))
    own = comments.groupBy("post_id").agg(
        F.count_if((F.col("kind") == "t1") & is_deleted(F.col("body"))).alias("deleted"),
        F.coalesce(F.sum(F.when(F.col("kind") == "more", F.col("more_count"))), F.lit(0)).alias("not_loaded"),
    )
    n = F.coalesce("n", F.lit(0))
    return own.join(live, "post_id", "left").select("post_id", F.least(n, F.lit(limit)).alias("rendered"), "deleted", "not_loaded", (n > limit).alias("limit_reached"))


def comment_block(path: Column, meta: Column, body: Column) -> Column:
    return F.concat(F.lit("**["), path, F.lit("]** "), meta, F.lit("\n\n"), demoted_headings(normalised_body(body)))


def grafted(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Flat replies whose parent is known, comes earlier in the batch, or is the post (``t3_``).

    ``fetched``: post_id, id, parent_id with its prefix, seq. A reply in a batch
    hangs on one before it only if that one was placed, so placing goes by levels.
    """
    short = fetched.withColumns({"parent": F.regexp_replace("parent_id", "^t[0-9]_", ""), "root": F.col("parent_id").startswith("t3_")})
    base = checkpointed(short)
    seen = known.select("post_id", F.col("id").alias("parent")).distinct()
    placed = base.where("root").unionByName(base.where("NOT root").join(seen, ["post_id", "parent"]).select(base.columns))

    def below(level):
        held = level.select("post_id", F.col("id").alias("parent"), F.col("seq").alias("_s")).distinct()
        child = base.where("NOT root").join(seen, ["post_id", "parent"], "left_anti").join(held, ["post_id", "parent"])
        return child.where("seq > _s").select(base.columns)

    return _descend(placed, below).select("post_id", "id", "parent_id", "parent", "seq")


def more_batches(ids: DataFrame, size: int = 100, most: int = 20) -> DataFrame:
    """Collapsed ids (post_id, id, seq) with the request that would fetch them; beyond ``most`` requests none."""
    n = F.row_number().over(Window.partitionBy("post_id").orderBy("seq")) - 1
    batch = F.floor(n / size).cast("int")
    return ids.withColumn("batch", F.when(batch < most, batch))


def stream_paths(stream: DataFrame) -> DataFrame:
    """Paths from a page's depth-coded comments (post_id, seq, depth, deleted): deleted ones raise what is below them."""

    def fold(pdf):
        counters, gone, paths = [], [], []
        for depth, deleted in zip(pdf.sort_values("seq")["depth"], pdf.sort_values("seq")["deleted"]):
            gone = [g for g in gone if g < depth]
            if deleted:
                gone.append(depth)
                paths.append(None)
                continue
            level = max(0, depth - len(gone))
            counters = [c or 1 for c in (counters + [0] * level)[:level]] + (counters[level : level + 1] or [0])
            counters[level] += 1
            paths.append(".".join(map(str, counters)))
        return pdf.sort_values("seq").assign(path=paths)[["post_id", "seq", "path"]]

    kinds = dict(stream.dtypes)
    return stream.groupBy("post_id").applyInPandas(fold, f"post_id {kinds['post_id']}, seq {kinds['seq']}, path string")


def active_branch(nodes: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(conv_id, node_id, depth from the leaf) from each conversation's leaf to its root.

    ``nodes``: conv_id, node_id, parent_id, created_at. Without a known leaf the
    newest node is it (ties: the larger id). A cycle ends where it closes. Each round doubles
    the branch, by pointers that skip as many nodes as it has. The result is a checkpoint.
    """
    newest = nodes.groupBy("conv_id").agg(F.max_by("node_id", F.struct("created_at", "node_id")).alias("node_id"))
    if leaves is not None:
        known = leaves.join(nodes.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_semi").groupBy("conv_id").agg(F.first("node_id").alias("leaf"))
        newest = newest.join(known, "conv_id", "left").select("conv_id", F.coalesce("leaf", "node_id").alias("node_id"))
    at = nodes.select("conv_id", "node_id").distinct()
    jumps = nodes.select("conv_id", "node_id", F.col("parent_id").alias("to")).where("to IS NOT NULL").join(at.withColumnRenamed("node_id", "to"), ["conv_id", "to"], "left_semi")
    jumps = checkpointed(jumps.select("conv_id", "node_id", "to").distinct())
    path = checkpointed(newest.select("conv_id", "node_id", F.lit(0).alias("depth")))
    reach, held = 1, path.count()
    while True:
        # The branch so far, and the same moved up by its length; on a cycle nothing is new.
        ahead = path.join(jumps, ["conv_id", "node_id"]).select("conv_id", F.col("to").alias("node_id"), (F.col("depth") + reach).alias("depth"))
        longer = checkpointed(path.unionByName(ahead).groupBy("conv_id", "node_id").agg(F.min("depth").alias("depth")))
        dropped(path)
        path, now = longer, longer.count()
        if now == held:
            dropped(jumps)
            return path
        held, reach = now, 2 * reach
        twice = jumps.join(jumps.select("conv_id", F.col("node_id").alias("to"), F.col("to").alias("further")), ["conv_id", "to"])
        twice = checkpointed(twice.select("conv_id", "node_id", F.col("further").alias("to")))
        dropped(jumps)
        jumps = twice


def exchanges(messages: DataFrame, order: str = "turn") -> DataFrame:
    """User and assistant messages with ``exchange`` numbers from 1; an assistant turn before any user turn is one of its own."""
    w = Window.partitionBy("conv_id").orderBy(order).rowsBetween(UNBOUNDED, 0)
    user = (F.col("role") == "user").cast("int")
    step = messages.where(F.col("role").isin("user", "assistant")).withColumn("_u", F.sum(user).over(w))
    opens = ((F.col("role") == "user") | (F.col("_u") == 0)).cast("int")
    return step.withColumn("exchange", F.sum(opens).over(w)).drop("_u")


def last_exchanges(messages: DataFrame, n: int, order: str = "turn") -> DataFrame:
    step = exchanges(messages, order)
    return step.withColumn("_m", F.max("exchange").over(Window.partitionBy("conv_id"))).where(F.col("exchange") > F.col("_m") - n).drop("_m")


def transcript(messages: DataFrame, n: int | None = None) -> DataFrame:
    """(conv_id, exchanges, messages, body): role blocks in order, joined by rules."""
    step = last_exchanges(messages, n) if n else exchanges(messages)
    time = F.col("time") if "time" in messages.columns else F.lit("")
    head = F.concat(F.lit("### "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.when(text_of(time) != "", F.concat(F.lit(" · "), time)).otherwise(""))
    block = F.struct("turn", F.concat(head, F.lit("\n\n"), text_of("text")).alias("md"))
    out = step.groupBy("conv_id").agg(F.countDistinct("exchange").alias("exchanges"), F.count("*").alias("messages"), F.array_sort(F.collect_list(block)).alias("b"))
    return out.select("conv_id", "exchanges", "messages", F.array_join(F.transform("b", lambda x: x["md"]), "\n\n---\n\n").alias("body"))


def role_of(attribute: Column, hint: Column, seq: Column) -> Column:
    """Role from an attribute, else from a hint text, else by turns from the user."""
    a, h = F.lower(text_of(attribute)), F.lower(text_of(hint))
    return (
        F.when(a.rlike("user|human|you"), "user").when(a.rlike("assistant|model|bot|ai"), "assistant")
        .when(h.rlike(r"user|human|prompt|query"), "user").when(h.rlike(r"assistant|response|answer|model|bot"), "assistant")
        .otherwise(F.when(seq % 2 == 0, "user").otherwise("assistant"))
    )


def self_thread(posts: DataFrame) -> DataFrame:
    """Posts (thread_id, seq, id, handle) with ``part``: thread for the unbroken run of the root's handle, reply after it."""
    w = Window.partitionBy("thread_id").orderBy("seq")
    root = F.first("handle").over(w)
    broken = F.max((F.col("handle") != root).cast("int")).over(w.rowsBetween(UNBOUNDED, 0))
    return posts.withColumn("part", F.when(broken == 0, "thread").otherwise("reply"))


def thread_slice(posts: DataFrame, root_id: Column) -> DataFrame:
    """Posts with ``place``: above, root or below the post named; without it, all are below."""
    at = F.max(F.when(F.col("id") == root_id, F.col("seq"))).over(Window.partitionBy("thread_id"))
    return posts.withColumn("place", F.when(F.col("seq") == at, "root").when(F.col("seq") < at, "above").otherwise("below"))


def by_numeric_id(df: DataFrame, group: str, ident: str = "id") -> DataFrame:
    """``seq`` by the number that an id ends with, whatever its length."""
    digits = F.regexp_replace(F.regexp_extract(F.col(ident), r"([0-9]+)\z", 1), "^0+", "")
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(F.length(digits), digits, ident)))


def carried_author(df: DataFrame, group: str, order: str, own: str | None = None) -> DataFrame:
    """Blank authors take the last one before them; with ``own``, own messages are by You."""
    name = F.nullif(text_of("author"), F.lit(""))
    name = F.when(F.col(own), "You").otherwise(name) if own else name
    w = Window.partitionBy(group).orderBy(order).rowsBetween(UNBOUNDED, 0)
    return df.withColumn("author", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("")))


def in_dates(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows dated within both days; undated rows stay and are marked."""
    c = F.col(column)
    test = F.lit(True)
    if start:
        test = test & (c >= F.lit(start).cast("date"))
    if end:
        test = test & (c <= F.lit(end).cast("date"))
    return df.where(c.isNull() | test).withColumn("undated", c.isNull())


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def first_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` of each group, with ``truncated`` where there were more."""
    w = Window.partitionBy(group)
    step = df.withColumns({"_r": F.row_number().over(w.orderBy(order)), "truncated": F.count("*").over(w) > n})
    return step.where(F.col("_r") <= n).drop("_r")


def in_view_order(payloads: DataFrame, view: DataFrame) -> DataFrame:
    """Payloads (page_id, key, ...) by the first place their key has in view (page_id, key, pos); a page without view keeps its own."""
    places = view.groupBy("page_id", "key").agg(F.min("pos").alias("pos"))
    seen = view.select("page_id", F.lit(True).alias("_v")).distinct()
    joined = payloads.join(places, ["page_id", "key"], "left").join(seen, "page_id", "left")
    return joined.where(F.col("pos").isNotNull() | F.col("_v").isNull()).drop("_v")


def file_tree(entries: DataFrame) -> DataFrame:
    """(repo, path, name, depth, is_dir, size) of files and of every folder above them, in drawing order ``ord``.

    Folders come before files, names in code point order.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    all_levels = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(i.alias("depth"), F.slice(F.col("p"), 1, i).alias("own"), ((i < F.size("p")) | (F.col("type") == "tree")).alias("is_dir"), F.when(i == F.size("p"), F.col("size")).alias("size")))
    rows = entries.withColumn("p", parts).where(F.size("p") > 0).select("repo", "p", F.explode(all_levels).alias("l")).select("repo", "l.*", "p")
    key = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.concat(F.when((i < F.col("depth")) | F.col("is_dir"), "0").otherwise("1"), F.get(F.col("p"), i - 1)))
    rows = rows.select("repo", F.array_join("own", "/").alias("path"), F.element_at("own", -1).alias("name"), "depth", "is_dir", "size", F.array_join(key, "\x00").alias("key"))
    rows = rows.groupBy("repo", "path", "name", "depth", "key").agg(F.max("is_dir").alias("is_dir"), F.max("size").alias("size"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("key"))).drop("key")


def drawn_tree(entries: DataFrame) -> DataFrame:
    """Lines of each repository's tree: ``(repo, ord, line)`` with branch marks."""
    tree = file_tree(entries)
    parent = F.when(F.col("depth") > 1, F.regexp_replace("path", r"/[^/]+\z", "")).otherwise("")
    tree = checkpointed(tree.withColumn("up", parent).withColumn("last", F.col("ord") == F.max("ord").over(Window.partitionBy("repo", "up"))))
    top = tree.where("depth = 1").select("repo", "path", "ord", "name", "is_dir", "last", F.lit("").alias("lead"))

    def below(level):
        held = level.where("is_dir").select("repo", F.col("path").alias("up"), F.concat("lead", F.when(F.col("last"), "    ").otherwise("│   ")).alias("lead"))
        return tree.join(held, ["repo", "up"]).where("depth > 1").select("repo", "path", "ord", "name", "is_dir", "last", "lead")

    mark = F.when(F.col("last"), "└── ").otherwise("├── ")
    return _descend(top, below).select("repo", "ord", F.concat("lead", mark, "name", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


def tree_counts(entries: DataFrame) -> DataFrame:
    return file_tree(entries).groupBy("repo").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"))


# Month names by their first letters, English and Russian, and words for near days.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTHS_RU = ("янв", "фев", "мар", "апр", "мая", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")


def separator_date(text: Column, now: Column) -> Column:
    """Today, yesterday, ``March 5``, ``5 March 2023``, Russian likewise; without a year the latest such day up to ``now``."""
    t = F.lower(F.trim(text_of(text)))
    names = F.create_map(*[F.lit(x) for group in (MONTHS, MONTHS_RU) for i, m in enumerate(group, 1) for x in (m, i)], F.lit("май"), F.lit(5))
    month_first, day_first = r"^(\p{L}{3})\p{L}*\.?\s+([0-9]{1,2})(?:,?\s+([0-9]{4}))?\z", r"^([0-9]{1,2})\s+(\p{L}{3})\p{L}*\.?,?(?:\s+([0-9]{4}))?\z"
    got = lambda p, k: F.regexp_extract(t, p, k)
    month = F.try_element_at(names, F.when(t.rlike(month_first), got(month_first, 1)).otherwise(got(day_first, 2)))
    day = F.when(t.rlike(month_first), got(month_first, 2)).otherwise(got(day_first, 1)).try_cast("int")
    year = F.when(t.rlike(month_first), got(month_first, 3)).otherwise(got(day_first, 3)).try_cast("int")
    make = lambda y: F.try_make_timestamp(y, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    this_year = make(F.year(now))
    rolled = F.when(this_year > now, make(F.year(now) - 1)).otherwise(this_year)
    return F.when(t.isin("today", "сегодня"), now).when(t.isin("yesterday", "вчера"), F.date_sub(now, 1)).when(month.isNotNull(), F.when(year.isNotNull(), make(year)).otherwise(rolled))


def period_dates(period: Column, today: Column) -> Column:
    """(start, end) of today, yesterday, week, month or year up to ``today``; null bounds for anything else."""
    pair = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    return (
        F.when(period == "today", pair(today, today)).when(period == "yesterday", pair(F.date_sub(today, 1), F.date_sub(today, 1)))
        .when(period == "week", pair(F.date_sub(today, 6), today)).when(period == "month", pair(F.add_months(today, -1), today))
        .when(period == "year", pair(F.add_months(today, -12), today)).otherwise(pair(F.lit(None), F.lit(None)))
    )


def engagement(replies: Column, reposts: Column, likes: Column, views: Column) -> Column:
    part = lambda x, name: F.when(x.isNotNull(), F.concat(number(x), F.lit(f" {name}")))
    return meta_line(part(replies, "replies"), part(reposts, "reposts"), part(likes, "likes"), part(views, "views"))
