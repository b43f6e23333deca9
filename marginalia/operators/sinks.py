"""Document sinks and summaries: merged documents, research reports, run snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import collapsed, safe_inline, safe_target, text_of, trimmed
from marginalia.operators.names import file_name, unique_names  # noqa: F401  (names of sinks)

SEPARATOR = "\n\n---\n\n"


def merged(df: DataFrame, batch: str, order: str, markdown: str = "markdown") -> DataFrame:
    """(batch, document, n): a batch's successful texts in order, joined by rules; batches without any give none."""
    good = df.where(F.col("success"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text_of(markdown).alias("m"))))
    return good.groupBy(batch).agg(F.array_join(F.transform(parts, lambda x: x["m"]), SEPARATOR).alias("document"), F.count("*").alias("n"))


def report_name(query: Column, day: Column, product: str = "research") -> Column:
    slug = F.substring(file_name(query), 1, 40)
    return F.concat(F.lit(f"{product}-"), slug, F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".md"))


def report(runs: DataFrame, results: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(run_id, markdown, tokens): front matter, numbered sources, what was not fetched, then the sections.

    ``runs``: run_id, query, day, engine, junk_filter, degraded. ``results``:
    run_id, pos, success, title, url, host, path, fetched_at, markdown,
    token_count, error, category, replacement. ``rejected``: run_id, pos, url, reason.
    """
    c = F.col
    place = F.sum(c("success").cast("int")).over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = results.withColumns({"n": place, "label": F.when(trimmed(text_of("title")) == "", safe_inline(c("url"))).otherwise(safe_inline(c("title")))})
    one_line = lambda x: trimmed(collapsed(text_of(x)))
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    source = text(c("n").cast("string"), ". [", c("label"), "](", safe_target(c("url")), ") — ", one_line("host"))
    quiet = c("path") == "quiet"
    section = text("## ", c("n").cast("string"), ". ", c("label"), "\nSource: ", one_line("url"), "\nFetched: ", text_of("fetched_at"), "\nCaptured: ", F.when(quiet, "server-rendered HTML, no tab").otherwise("rendered in a background tab"), "\n\n", text_of("markdown"))
    failure = text("- ", one_line("url"), " — ", F.coalesce(F.nullif(one_line("error"), F.lit("")), F.lit("Conversion failed")))
    ordered = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(c("pos").alias("p"), value.alias("v"))))), lambda x: x["v"])
    agg = rows.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(c("success") & quiet).alias("quiet"),
        F.coalesce(F.sum(F.when(c("success"), c("token_count"))), F.lit(0)).alias("tokens"), F.count_if("replacement").alias("stood_in"),
        F.count_if(~c("success") & c("category").isin("junk", "duplicate")).alias("junked"),
        ordered(c("success"), source).alias("sources"), ordered(c("success"), section).alias("sections"), ordered(~c("success"), failure).alias("failures"),
    )
    if rejected is not None:
        skipped = text("- ", one_line("url"), " — ", one_line("reason"), " (skipped before fetching)")
        listed = rejected.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(c("pos").alias("p"), skipped.alias("v")))), lambda x: x["v"]).alias("skipped"))
        agg = agg.join(listed, "run_id", "left")
    else:
        agg = agg.withColumn("skipped", F.lit(None).cast("array<string>"))
    full = agg.join(runs, "run_id")
    num = lambda name: c(name).cast("string")
    none = F.array().cast("array<string>")
    misses = F.concat("failures", F.coalesce("skipped", none))
    dropped = F.when(c("junked") > 0, text(", ", num("junked"), " page(s) dropped by it")).otherwise("")
    front = F.array_compact(
        F.array(
            F.lit("---"), text("Research: ", text_of("query")), text("Date: ", F.date_format("day", "yyyy-MM-dd")), text("Engine: ", text_of("engine")),
            text("Sources: ", num("ok"), " of ", num("total"), " fetched"),
            text("Capture: ", num("quiet"), " fetched without a tab, ", (c("ok") - c("quiet")).cast("string"), " rendered in a background tab"),
            text("Tokens: ~", num("tokens"), " (o200k_base estimate)"), text("Quality filter: ", F.when(c("junk_filter"), "on").otherwise("off"), dropped),
            F.when(c("stood_in") > 0, text("Replacements: ", num("stood_in"), " further candidate(s) were pulled in for dropped sources")),
            F.when(text_of("degraded") != "", text("Notes: ", c("degraded"))), F.lit("---"),
        )
    )
    sources = F.concat(F.array(F.lit("## Sources")), F.when(c("ok") > 0, c("sources")).otherwise(F.array(F.lit("_No source could be captured._"))))
    sources = F.concat(sources, F.when(F.size(misses) > 0, F.concat(F.array(F.lit(""), F.lit("### Not fetched"), F.lit("")), misses)).otherwise(none))
    head = F.concat(F.array_join(front, "\n"), F.lit("\n\n"), F.array_join(sources, "\n"))
    return full.select("run_id", F.array_join(F.concat(F.array(head), c("sections")), SEPARATOR).alias("markdown"), "tokens")


def snapshot(entries: DataFrame) -> DataFrame:
    """Counts of each run's entries by status, path and category, and the tokens captured."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    ok = F.col("status") == "ok"
    return entries.groupBy("run_id").agg(
        F.count("*").alias("total"), *[status(s) for s in ("pending", "fetching", "ok", "error", "skipped")],
        F.count_if(ok & (F.col("path") == "quiet")).alias("quiet"), F.count_if(ok & (F.col("path") == "tab")).alias("rendered"),
        F.count_if(F.col("category").isin("junk", "duplicate")).alias("dropped"), F.count_if("replacement").alias("replacements"),
        F.count_if(F.col("status").isin("ok", "error", "skipped")).alias("completed"), F.coalesce(F.sum(F.when(ok, F.col("token_count"))), F.lit(0)).alias("tokens"),
    )


def failure_summary(entries: DataFrame) -> DataFrame:
    """``2 failed, 1 skipped, 3 dropped`` of each run, without terms that are zero."""
    dropped = F.col("category").isin("junk", "duplicate")
    counts = entries.groupBy("run_id").agg(
        F.count_if((F.col("status") == "error") & ~F.coalesce(dropped, F.lit(False)) & ~F.coalesce(F.col("category").isin("wall", "unusable"), F.lit(False))).alias("f"),
        F.count_if((F.col("status") == "error") & F.col("category").isin("wall", "unusable")).alias("s"),
        F.count_if(F.coalesce(dropped, F.lit(False))).alias("d"),
    )
    term = lambda n, name: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {name}")))
    return counts.select("run_id", F.concat_ws(", ", term("f", "failed"), term("s", "skipped"), term("d", "dropped")).alias("summary"))


def tab_summary(results: DataFrame, batch: str) -> DataFrame:
    ok = F.count_if("success")
    bad = F.count("*") - ok
    said = F.concat(ok.cast("string"), F.when(ok > 1, " tabs").otherwise(" tab"), F.when(bad > 0, F.concat(F.lit(" ("), bad.cast("string"), F.lit(" failed)"))).otherwise(""))
    return results.groupBy(batch).agg(said.alias("message"), ok.alias("n_ok"), bad.alias("n_failed"))


def write_folder(df: DataFrame, path: str, batch: str) -> None:
    """The distributed form: a Parquet folder of (name, markdown), one part of the tree for each batch."""
    df.write.partitionBy(batch).parquet(path)
