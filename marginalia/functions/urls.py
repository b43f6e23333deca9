"""URL operators: hosts, keys, guards and site routing as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import text_of

# What makes a parameter a tracker, a path a file, a destination private.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|ref|rut)\z"
NOT_PAGES = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz|mp[34]|avi|mov|webm|jpe?g|png|gif|svg|webp|epub|csv)(\?|#|\z)"
LOW_VALUE_PATH = r"/tag/|/category/|/search\?|/page/[0-9]"
PRIVATE_SUFFIXES = (".local", ".internal", ".home.arpa", ".localhost")
SKIPPED_TABS = ("chrome://", "edge://", "about:", "chrome-extension://", "moz-extension://")
_SCHEME, _AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def _str(url) -> Column:
    return F.trim(text_of(url))


def scheme_of(url) -> Column:
    """Lower-case scheme, '' if there is none."""
    return F.lower(F.regexp_extract(_str(url), _SCHEME, 1))


def hostname(url) -> Column:
    """Lower-case host, ``www.`` kept; '' where a URL names none or has white space in its host."""
    host = F.lower(F.regexp_extract(_str(url), _AUTHORITY, 1))
    return F.when(host.rlike(r"[\s<>^|%]"), "").otherwise(host)


def host_of(url) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def path_of(url) -> Column:
    path = F.regexp_extract(_str(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when((hostname(url) != "") & (path == ""), "/").otherwise(path)


def query_of(url) -> Column:
    """The query with its question mark, '' if empty."""
    found = F.regexp_extract(_str(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(found == "?", "").otherwise(found)


def fragment_of(url) -> Column:
    return F.regexp_extract(_str(url), r"^[^#]*(#.*)", 1)


def host_in(host: Column, listed) -> Column:
    """Whether the host is one of ``listed`` or below one."""
    test = F.lit(False)
    for entry in listed:
        test = test | (host == entry) | host.endswith("." + entry)
    return test


def unwrapped(href: Column) -> Column:
    """The target of a redirect link, or the link itself if it is absolute; null otherwise."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    wrapped = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    target = F.try_url_decode(F.replace(wrapped, F.lit("+"), F.lit("%2B")))
    http = r"(?i)^https?://"
    return F.when(wrapped != "", F.when(target.rlike(http), target)).when(href.rlike(http), href)


def clean_query(url) -> Column:
    """The query without tracking parameters."""
    query = query_of(url)
    kept = F.filter(F.split(F.substring(query, 2, 1_000_000), "&"), lambda p: ~F.substring_index(p, "=", 1).rlike(TRACKING))
    tracked = F.exists(F.split(F.substring(query, 2, 1_000_000), "&"), lambda p: F.substring_index(p, "=", 1).rlike(TRACKING))
    joined = F.array_join(F.filter(kept, lambda p: p != ""), "&")
    return F.when(~tracked, query).when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def without_tracking(url) -> Column:
    """The URL, normalised in scheme, host and empty path, without tracking parameters."""
    port = F.regexp_extract(_str(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:[0-9]+)(?:[/?#]|\z)", 1)
    default = ((scheme_of(url) == "http") & (port == ":80")) | ((scheme_of(url) == "https") & (port == ":443"))
    return F.concat(scheme_of(url), F.lit("://"), hostname(url), F.when(default, "").otherwise(port), path_of(url), clean_query(url), fragment_of(url))


def dedup_key(url) -> Column:
    """Host without www, path without trailing slashes, query without trackers; neither scheme nor fragment."""
    return F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+\z", ""), clean_query(url))


def not_a_page(url) -> Column:
    return F.concat(path_of(url), query_of(url)).rlike(NOT_PAGES)


def path_depth(url) -> Column:
    return F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != ""))


def low_value(url) -> Column:
    return F.concat(path_of(url), query_of(url)).rlike(LOW_VALUE_PATH)


def _private_v4(host: Column) -> Column:
    """The private, local, shared and reserved IPv4 ranges."""
    n = F.transform(F.split(host, r"\."), lambda p: F.when(p.rlike(r"^[0-9]{1,3}\z"), p.cast("int")))
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    four = (F.size(n) == 4) & F.forall(n, lambda x: F.coalesce(x <= 255, F.lit(False)))
    ranges = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return four & F.coalesce(ranges, F.lit(False))


def _private_v6(host: Column) -> Column:
    inner = F.regexp_extract(host, r"^\[(.*)\]\z", 1)
    mapped = F.regexp_extract(inner, r"^::ffff:([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z", 1)
    return host.startswith("[") & (inner.isin("::1", "::") | inner.rlike(r"^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:") | _private_v4(mapped))


def private_reason(url) -> Column:
    """Why a URL is refused before anything is fetched, or null."""
    host, scheme = hostname(url), scheme_of(url)
    inside = (host == "localhost") | F.lit(False)
    for suffix in PRIVATE_SUFFIXES:
        inside = inside | host.endswith(suffix)
    inside = inside | ~F.contains(host, F.lit(".")) | _private_v4(host) | _private_v6(host)
    return (
        F.when((scheme == "") | (scheme.isin("http", "https") & (host == "")), "Refused: this URL could not be parsed")
        .when(~scheme.isin("http", "https"), F.concat(F.lit("Refused: "), scheme, F.lit(": is not a web page address")))
        .when(inside, "Refused: this URL points at a private address")
    )


def capturable_tab(url) -> Column:
    """Tabs with a URL that is not a browser page."""
    test = _str(url) != ""
    for prefix in SKIPPED_TABS:
        test = test & ~_str(url).startswith(prefix)
    return test


def absolute_permalink(link: Column) -> Column:
    return F.when(link.rlike(r"(?i)^https?://"), link).when(link == "", "").otherwise(F.concat(F.lit("https://www.reddit.com"), link))


# Reserved first path segments, hosts and thread shapes of the sites with readers of their own.
X_RESERVED = ("home", "explore", "notifications", "messages", "settings", "search", "compose", "i", "login", "signup", "tos", "privacy", "jobs", "hashtag", "share", "intent")
GITHUB_RESERVED = ("settings", "marketplace", "explore", "topics", "trending", "collections", "events", "sponsors", "features", "login", "join", "about", "pricing", "notifications", "search", "orgs", "apps", "new", "organizations", "issues", "pulls", "codespaces", "stars", "dashboard")


def route(url) -> Column:
    """(site, page_type) of a URL whose site has a reader, null for the rest; the first site that claims it wins."""
    host, path, query, fragment = hostname(url), path_of(url), query_of(url), fragment_of(url)
    first, second = F.regexp_extract(path, "^/([^/]+)", 1), F.regexp_extract(path, "^/[^/]+/([^/]+)", 1)
    to = lambda site, kind: F.struct(F.lit(site).alias("site"), F.lit(kind).alias("page_type"))
    reddit, x = host.rlike(r"(^|\.)reddit\.com\z"), host.rlike(r"(^|\.)(x|twitter)\.com\z")
    tube = host.rlike(r"(^|\.)youtube\.com\z")
    return (
        F.when(reddit & path.rlike(r"^/((r|u|user)/[^/]+/)?comments/[A-Za-z0-9]+"), to("reddit", "post"))
        .when(reddit & path.rlike(r"^/?\z|^/(r|u|user)/[^/]+(/(hot|new|top|rising|best|controversial|submitted))?/?\z|^/(hot|new|top|rising|best|popular|all)/?\z"), to("reddit", "listing"))
        .when(host.rlike(r"^(www\.)?github\.com\z") & (first != "") & (second != "") & ~F.lower(first).isin(*GITHUB_RESERVED) & path.rlike(r"^/[^/]+/[^/]+(/?|/tree/.+)\z"), to("github", "repository"))
        .when(host.rlike(r"(^|\.)web\.telegram\.org\z") & fragment.rlike(r"^#(-?[0-9]+(_[0-9]+)?|@[A-Za-z0-9_]+)"), to("telegram", "chat"))
        .when((tube & (path == "/watch") & query.rlike(r"[?&]v=[A-Za-z0-9_-]+")) | (tube & path.rlike(r"^/shorts/[A-Za-z0-9_-]+")) | ((host == "youtu.be") & path.rlike(r"^/[A-Za-z0-9_-]+")), to("youtube", "video"))
        .when(host.rlike(r"(^|\.)discord\.com\z") & path.rlike(r"^/channels/(@me|[0-9]+)/[0-9]+"), to("discord", "channel"))
        .when(x & path.rlike(r"^/[A-Za-z0-9_]+/status/[0-9]+"), to("x", "post"))
        .when(x & path.rlike(r"^/(home|explore|search)?/?\z"), to("x", "feed"))
        .when(x & path.rlike(r"^/hashtag/"), to("x", "hashtag"))
        .when(x & path.rlike(r"^/i/lists/[0-9]+"), to("x", "list"))
        .when(x & path.rlike(r"^/[A-Za-z0-9_]{1,15}(/(with_replies|media|likes))?/?\z") & ~F.lower(first).isin(*X_RESERVED), to("x", "profile"))
    )
