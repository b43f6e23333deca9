"""Decision tables for captures: guards, bot checks, responses, extractions, the two-attempt ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import urls
from marginalia.functions.text import text_of

# Thresholds in characters, statuses, markers of walls and their vendors.
MIN_TEXT, MIN_BODY_TEXT, THIN_TEXT = 500, 200, 1500
MAX_BYTES = 5 * 1024 * 1024
CHALLENGE_BODY = 60_000
DEAD = (404, 410)
REPEATED = (401, 403, 429)
VENDORS = (
    (r"(?i)cdn-cgi/challenge-platform|__cf_chl|_cf_chl_opt|cf-browser-verification", "Cloudflare"),
    (r"(?i)challenges\.cloudflare\.com", "Cloudflare"),
    (r"(?i)captcha-delivery\.com|datadome", "DataDome"),
    (r"(?i)px-captcha|perimeterx|_pxhd|captcha\.px-cloud\.net", "PerimeterX"),
    (r"(?i)geo\.captcha-delivery|imperva|incapsula", "Imperva"),
)
CAPTCHA = r"(?i)(hcaptcha\.com/1/api\.js|www\.google\.com/recaptcha/api\.js|g-recaptcha|h-captcha)"
PAYWALL = r'(?i)(subscribe to (?:continue|read)|subscription required|to continue reading|this (?:article|content) is for subscribers|paywall|piano\.io|"isAccessibleForFree"\s*:\s*(?:"|)?false)'
LOGIN = r"""(?i)(type=["']password["']|sign in to (?:continue|view|read)|log ?in to (?:continue|view|read)|please (?:sign in|log ?in)|accept (?:all )?cookies|consent to (?:the use of )?cookies|manage your (?:cookie )?preferences)"""
WALL = r"(?i)(^|\.)consent\.|/consent|cookie|gdpr|login|signin|accounts\."
HTML_TYPES, TEXT_TYPES = ("text/html", "application/xhtml+xml"), ("text/plain", "text/markdown", "text/x-markdown")
PDF = "PDFs open in the browser's viewer, where extensions cannot run"


def verdict(decision: str, reason, category: str | None) -> Column:
    reason = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    return F.struct(F.lit(decision).alias("decision"), reason.cast("string").alias("reason"), F.lit(category).cast("string").alias("category"))


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(text_of(header), ";", 1)))


def opens_like_html(body: Column) -> Column:
    return F.substring(text_of(body), 1, 256).rlike(r"(?i)^\s*(<!doctype\s+html|<html[\s>]|<\?xml|<!--)")


def response_kind(header: Column, status: Column, body: Column) -> Column:
    """html, text, nonHtml, httpError or tooLarge of a stored response."""
    kind = media_type(header)
    html = kind.isin(*HTML_TYPES) | ((kind == "") & opens_like_html(body))
    return (
        F.when(F.octet_length(text_of(body)) > MAX_BYTES, "tooLarge")
        .when(kind.isin(*TEXT_TYPES), "text")
        .when(~html, "nonHtml")
        .when(~status.between(200, 299), "httpError")
        .otherwise("html")
    )


def challenge_vendor(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, vendor in reversed(VENDORS):
        out = F.when(text_of(html).rlike(pattern), vendor).otherwise(out)
    return out


def challenge_reason(html: Column, status: Column) -> Column:
    body = text_of(html)
    vendor = challenge_vendor(html)
    small = (F.length(body) <= CHALLENGE_BODY) | F.coalesce(~status.between(200, 299), F.lit(False))
    return F.when(vendor.isNotNull(), F.concat(F.lit("Blocked by a "), vendor, F.lit(" bot challenge, which a background capture cannot answer"))).when(
        (body != "") & small & body.rlike(CAPTCHA), "Blocked by a CAPTCHA gate, which a background capture cannot answer"
    )


def preflight(url, reddit: bool = True, x: bool = True) -> Column:
    """The verdict before anything is fetched, or null."""
    host, refused = urls.hostname(url), urls.private_reason(url)
    out = F.when(refused.isNotNull(), verdict("reject", refused, "unusable"))
    if reddit:
        out = out.when(host.rlike(r"(^|\.)reddit\.com\z"), verdict("render", "Reddit's comment tree needs the page's own session, so a tab was opened", None))
    if x:
        out = out.when(host.rlike(r"(^|\.)(x\.com|twitter\.com)\z"), verdict("render", "X timelines are virtualised, so a tab was opened", None))
    return out


def classify_responses(responses: DataFrame) -> DataFrame:
    """Responses with ``verdict`` (decision, reason, category).

    Needs source_id, attempt, kind, status, requested_url, final_url,
    content_type, body, bytes and message. Statuses of a source's earlier
    attempts count as seen.
    """
    w = Window.partitionBy("source_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    step = responses.withColumn("_seen", F.array_contains(F.coalesce(F.collect_set("status").over(w), F.array().cast("array<int>")), F.coalesce(F.col("status"), F.lit(-1)).cast("int")))
    c = F.col
    status = c("status").cast("string")
    dead = F.concat(F.lit("Server answered "), status, F.lit(": the page is not there, and a tab cannot bring it back"))
    retry = F.concat(F.lit("Server answered "), status, F.lit(", so a tab was opened"))
    seen_bytes = F.when(F.coalesce(c("bytes"), F.lit(0)) > 0, F.concat(F.lit(" ("), c("bytes").cast("string"), F.lit(" bytes)"))).otherwise("")
    large = F.concat(F.lit("Page was larger than 5 MB"), seen_bytes, F.lit(", so it was not captured"))
    asked, final = urls.hostname("requested_url"), urls.hostname("final_url")
    path = F.concat(urls.path_of("final_url"), urls.query_of("final_url"))
    moved = (asked != "") & (asked != final)
    wall = (c("final_url") != c("requested_url")) & (final != "") & ((moved & final.rlike(WALL)) | path.rlike(WALL))
    where = F.when(moved, final).otherwise(F.concat(final, path))
    challenge = challenge_reason(c("body"), c("status"))
    out = (
        F.when(c("kind").isNull(), verdict("reject", "No response", "unusable"))
        .when(c("kind") == "networkError", verdict("reject", c("message"), "transient"))
        .when(c("kind") == "blocked", verdict("reject", c("message"), "unusable"))
        .when(c("kind") == "tooLarge", verdict("reject", large, "unusable"))
        .when((c("kind") == "nonHtml") & (c("content_type") == "application/pdf"), verdict("reject", PDF, "unusable"))
        .when((c("kind") == "nonHtml") & (text_of("content_type") == ""), verdict("reject", "Server did not say what it sent, and it does not open like a web page", "unusable"))
        .when(c("kind") == "nonHtml", verdict("reject", F.concat(F.lit("Not a web page: "), c("content_type")), "unusable"))
        .when((c("kind") == "text") & c("status").isin(*DEAD), verdict("reject", dead, "unusable"))
        .when((c("kind") == "text") & ~c("status").between(200, 299), verdict("render", retry, "transient"))
        .when(c("kind") == "text", verdict("use", None, None))
        .when(challenge.isNotNull(), verdict("reject", challenge, "wall"))
        .when((c("kind") == "httpError") & c("status").isin(*DEAD), verdict("reject", dead, "unusable"))
        .when((c("kind") == "httpError") & c("status").isin(*REPEATED) & c("_seen"), verdict("reject", F.concat(F.lit("Server answered "), status, F.lit(" again after a retry: this site refuses automated access")), "wall"))
        .when(c("kind") == "httpError", verdict("render", retry, "transient"))
        .when(F.coalesce(wall, F.lit(False)), verdict("render", F.concat(F.lit("Redirected to "), where, F.lit(", so a tab was opened")), "wall"))
        .otherwise(verdict("use", None, None))
    )
    return step.withColumn("verdict", out).drop("_seen")


def classify_extraction() -> Column:
    """Verdict on a parsed page: failed, error, empty_app_shell, body_text_length, text_length, html, status, attempt."""
    c = F.col
    length = F.coalesce(c("text_length"), F.lit(0))
    challenge = challenge_reason(c("html"), c("status"))
    failed = F.coalesce(c("failed"), F.lit(True))
    shell = F.coalesce(c("empty_app_shell"), F.lit(False)) & (c("body_text_length") < MIN_BODY_TEXT)
    short, html = length < MIN_TEXT, text_of("html")
    return (
        F.when(failed & challenge.isNotNull(), verdict("reject", challenge, "wall"))
        .when(failed, verdict("render", F.concat(F.lit("Server-rendered HTML could not be converted ("), F.coalesce(F.nullif(c("error"), F.lit("")), F.lit("unknown error")), F.lit("), so a tab was opened")), "transient"))
        .when(shell, verdict("render", "Page is rendered by JavaScript, so a tab was opened", "transient"))
        .when(short & html.rlike(PAYWALL), verdict("reject", "Hard paywall: the page offered a subscription instead of the article", "wall"))
        .when(short & html.rlike(LOGIN) & (F.coalesce(c("attempt"), F.lit(1)) > 1), verdict("reject", "Login or consent wall: the page yielded no article, in a tab either", "wall"))
        .when(short & html.rlike(LOGIN), verdict("render", "Page asked for a login or a consent choice, so a tab was opened", "wall"))
        .when(short, verdict("render", F.concat(F.lit("Server-rendered text was only "), length.cast("string"), F.lit(" characters, so a tab was opened")), "transient"))
        .otherwise(verdict("use", None, None))
    )


def is_thin(length: Column) -> Column:
    return length.between(MIN_TEXT, THIN_TEXT - 1)


def retryable(category: Column) -> Column:
    return category.isNull() | (category == "transient")


def ladder(attempts: DataFrame) -> DataFrame:
    """One row per source of attempts (source_id, attempt, success, error, category, seconds_left).

    A second attempt counts only if the first failed in a retryable way with
    time left; the outcome is that of the last attempt that counts, and a
    failure tells of both when their words differ.
    """
    first = F.min_by(F.struct("success", "error", "category", "seconds_left"), "attempt")
    second = F.min_by(F.when(F.col("attempt") > 1, F.struct("success", "error", "category")), F.when(F.col("attempt") > 1, F.col("attempt")))
    both = attempts.groupBy("source_id").agg(first.alias("a"), second.alias("b"))
    may = ~F.col("a.success") & retryable(F.col("a.category"))
    withheld = may & (F.coalesce(F.col("a.seconds_left"), F.lit(240)) < 40)
    use = may & ~withheld & F.col("b").isNotNull()
    error = F.when(use & ~F.col("b.success") & (F.col("a.error") != F.col("b.error")), F.concat("a.error", F.lit("; on retry: "), "b.error")).when(use, F.col("b.error")).otherwise(F.col("a.error"))
    success = F.when(use, F.col("b.success")).otherwise(F.col("a.success"))
    note = F.when(withheld, "no retry: the run was nearly out of time")
    return both.select("source_id", success.alias("success"), F.when(~success, error).alias("error"), F.when(~success, F.when(use, F.col("b.category")).otherwise(F.col("a.category"))).alias("category"), F.when(use, 2).otherwise(1).alias("attempts"), note.alias("note"))


def row_state(status: Column, category: Column) -> Column:
    """How a failed entry is shown: skipped for walls, unusable pages and dropped ones, failed otherwise."""
    return F.when((status == "error") & category.isin("wall", "unusable", "junk", "duplicate", "budget", "cancelled"), "skipped").when(status == "error", "failed").otherwise(status)


def source_notes(url, scrolled: Column) -> Column:
    host = urls.hostname(url)
    return F.array_compact(F.array(F.when(scrolled, "the page was scrolled before capture"), F.when(host.rlike(r"(^|\.)(x\.com|twitter\.com)\z"), "only the posts that were loaded are included")))
