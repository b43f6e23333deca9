"""DuckDB SQL for the queries of the registry that SQL can express, written apart from their plans."""

from __future__ import annotations

WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
FENCE = r"(?s)```.*?(?:```|\z)"
LINK = rf'\[([^\]]*)\]\(([^){WS}]*)(?:[{WS}]+"[^"]*")?\)'


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '{LINK}', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '[#>*_`|~]', ' ', 'g'), '[{WS}]+', ' ', 'g')"


def _stats(question: str) -> str:
    from marginalia.operators.quality import AFFILIATE, CTA, PROMO, QUERY_STOP, SIGNALS

    count = lambda patterns: " + ".join("len(regexp_extract_all(low, '" + p.replace("'", "''") + "'))" for p in patterns)
    stop = ", ".join(f"'{w}'" for w in QUERY_STOP)
    return f"""
raw AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{FENCE}', ' ', 'g') AS raw FROM documents),
plain AS (SELECT doc_id, raw, {_PLAIN} AS plain FROM raw),
base AS (SELECT doc_id, raw, lower(plain) AS low, len({_words("plain")}) AS n,
         list_filter(list_transform(string_split(raw, chr(10)), lambda x: {_trim("x")}), lambda x: x <> '') AS lines FROM plain),
terms AS (SELECT list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower('{question}'), '[^a-z0-9{WS}-]', ' ', 'g'), '[{WS}]+'),
          lambda w: len(w) >= 3 AND w NOT IN ({stop}))) AS terms),
m AS (SELECT doc_id, n, len(lines) AS n_lines,
  len(lines) - len(list_distinct(list_transform(lines, lambda x: regexp_replace(lower(x), '[{WS}]+', ' ', 'g')))) AS dups,
  coalesce(list_sum(list_filter(list_transform(lines, lambda x: len({_words(f"regexp_replace(regexp_replace(x, '{LINK}', '\\1', 'g'), '[#>*_`|~]', ' ', 'g')")})), lambda k: k >= 20)), 0) AS substantial,
  len(list_filter(lines, lambda x: regexp_matches(x, '^#{{1,6}}[{WS}]'))) AS headings,
  len(regexp_extract_all(raw, '{LINK}', 2)) AS links,
  coalesce(list_sum(list_transform(regexp_extract_all(raw, '{LINK}', 1), lambda x: len({_words("x")}))), 0) AS link_words,
  len(list_filter(regexp_extract_all(raw, '{LINK}', 2), lambda x: regexp_matches(x, '{AFFILIATE}'))) AS affiliates,
  {count(PROMO)} AS promo, {count(CTA)} AS cta, {count(SIGNALS)} AS signals,
  len(terms) AS n_terms, len(list_filter(terms, lambda t: contains(low, t))) AS matched
  FROM base, terms)"""


def all_of() -> dict[str, str]:
    from marginalia.functions.text import NAMED_ENTITIES
    from marginalia.operators.routing import LAZY_HOSTS
    from marginalia.plans.registry import CHAT_SHAPES, HARVEST_SECONDS, QUESTION

    share = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / {b} ELSE 0.0 END"
    # Documents have no URL of their own, so no link is outbound; channel pitches are tested apart, on rows that have some.
    stats = f"""WITH {_stats(QUESTION)}
SELECT doc_id, n AS word_count, links::BIGINT AS link_count, link_words::BIGINT AS link_text_words, affiliates::BIGINT AS affiliate_links, 0::BIGINT AS outbound_links,
  headings::BIGINT AS headings, round({share("dups", "n_lines")}, 9) AS duplicate_line_share, round({share("substantial", "n")}, 9) AS substantial_word_share,
  round({share("link_words", "n")}, 9) AS link_text_share, round({share("links * 100", "n")}, 9) AS links_per_100_words, round(promo * {share("1000", "n")}, 9) AS promo_per_1000,
  round(cta * {share("1000", "n")}, 9) AS cta_per_1000, signals::BIGINT AS signal_selling_hits, 0::BIGINT AS channel_pitch_hits,
  n_terms::BIGINT AS query_term_count, matched::BIGINT AS query_terms_matched, round(CASE WHEN n_terms > 0 THEN matched / n_terms ELSE 1.0 END, 9) AS query_overlap FROM m"""

    def points(question: str) -> str:
        return f"""WITH {_stats(question)},
s AS (SELECT *, {share("dups", "n_lines")} AS dup, {share("substantial", "n")} AS prose, promo * {share("1000", "n")} AS pr, cta * {share("1000", "n")} AS ct FROM m),
r AS (
  SELECT doc_id, 0 AS ord, CASE WHEN signals >= 2 THEN 100 WHEN signals = 1 THEN 30 END AS points, CASE WHEN signals >= 2 THEN signals || ' paid-signal or VIP-channel pitches' ELSE 'a paid-signal or VIP-channel pitch' END AS text FROM s
  UNION ALL SELECT doc_id, 2, CASE WHEN pr >= 10 THEN 70 WHEN pr >= 6 THEN 50 WHEN pr >= 3 THEN 30 WHEN pr >= 1.5 THEN 12 END, printf('%.1f', pr) || ' promotional phrases per 1000 words' FROM s
  UNION ALL SELECT doc_id, 3, CASE WHEN ct >= 6 THEN 30 WHEN ct >= 3 THEN 15 END, printf('%.1f', ct) || ' calls to action per 1000 words' FROM s
  UNION ALL SELECT doc_id, 7, CASE WHEN dup >= 0.3 THEN 20 END, floor(dup * 100 + 0.5)::INT || '% of the lines are repeats' FROM s
  UNION ALL SELECT doc_id, 8, CASE WHEN n >= 120 AND prose < 0.2 THEN 25 WHEN n >= 120 AND prose < 0.4 THEN 10 END, CASE WHEN prose < 0.2 THEN 'almost none of the page is written in paragraphs' ELSE 'only ' || floor(prose * 100 + 0.5)::INT || '% of the page is written in paragraphs' END FROM s
  UNION ALL SELECT doc_id, 9, CASE WHEN n < 90 THEN 35 WHEN n < 220 THEN 20 END, 'only ' || n || ' words of content' FROM s
  UNION ALL SELECT doc_id, 10, CASE WHEN headings >= 6 AND n / headings < 35 THEN 15 END, headings || ' headings with almost nothing under them' FROM s
  UNION ALL SELECT doc_id, 11, CASE WHEN n_terms > 0 AND matched = 0 THEN 30 WHEN n_terms > 0 AND matched / n_terms < 0.25 THEN 10 END, CASE WHEN matched = 0 THEN 'none of the question''s terms appear on the page' ELSE 'only ' || matched || ' of ' || n_terms || ' question terms appear on the page' END FROM s
  UNION ALL SELECT doc_id, 12, CASE WHEN n_terms >= 2 AND matched = 0 AND n >= 120 AND prose < 0.4 THEN 100 END, 'the page is about something else and is a list of links rather than prose' FROM s)"""

    score = f"""{points("")}, t AS (SELECT doc_id, coalesce(sum(points), 0) AS score,
  string_agg(text, ' and ' ORDER BY k) FILTER (WHERE k <= 2) AS spoken
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, ord) AS k FROM r WHERE points IS NOT NULL) GROUP BY doc_id)
SELECT s.doc_id, coalesce(score, 0)::INT AS score, CASE WHEN score >= 100 THEN 'reject' ELSE 'keep' END AS verdict,
  CASE WHEN score >= 100 THEN 'Dropped as low-value: ' || spoken END AS reason FROM s LEFT JOIN t USING (doc_id)"""
    pieces = r"(?:'s|'t|'re|'ve|'m|'ll|'d)| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+".replace("WS", WS).replace("'", "''")
    host = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
    bare = f"regexp_replace({host}, '^www\\.', '')"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    query = r"regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)"
    kept = f"list_filter(string_split(substr({query}, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.*|fbclid|gclid|ref|rut)$'))"
    clean = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    url_parts = f"p AS (SELECT page_id, url, html, {host} AS www, {bare} AS host, CASE WHEN {path} = '' THEN '/' ELSE {path} END AS path, {clean} AS query, {query} AS full_query FROM pages)"
    shapes = ", ".join(f"'{x}'" for x in CHAT_SHAPES)
    # The sites by expressions over whole hosts, where the library joins suffixes of labels.
    sites = [
        ("claude", "Claude", r"(^|\.)claude\.ai$", "path LIKE '/chat/%' AND regexp_matches(path, '^/chat/[0-9a-fA-F-]{36}')"),
        ("chatgpt", "ChatGPT", r"(^|\.)(chatgpt\.com|chat\.openai\.com)$", "regexp_matches(path, '(?i)^/(c|g/[^/]+/c|share)/[0-9a-z-]{16,}')"),
        ("google-ai", "Google AI Mode", r"(^|\.)google\.[a-z]{2,3}(\.[a-z]{2})?$", "path LIKE '/search%' AND regexp_extract(url, '[?&]udm=([^&#]*)', 1) = '50'"),
        ("gemini", "Gemini", r"(^|\.)gemini\.google\.com$", "regexp_matches(path, '(?i)^/(app|share)/')"),
        ("grok", "Grok", r"(^|\.)(grok\.com|x\.ai)$", "regexp_matches(path, '(?i)^/(chat|c|share)/')"),
        ("perplexity", "Perplexity", r"(^|\.)perplexity\.ai$", "regexp_matches(path, '(?i)^/(search|page)/')"),
        ("deepseek", "DeepSeek", r"(^|\.)deepseek\.com$", "regexp_matches(path, '(?i)^/a/chat/')"),
        ("copilot", "Copilot", r"(^|\.)copilot\.microsoft\.com$", "regexp_matches(path, '(?i)^/(chats?|c)/')"),
        ("mistral", "Le Chat", r"(^|\.)chat\.mistral\.ai$", "regexp_matches(path, '(?i)^/chat/')"),
        ("cursor", "Cursor", r"(^|\.)cursor\.(com|sh)$", "regexp_matches(path, '(?i)^/(agents?|chat|dashboard)')"),
        ("openwebui", "Local chat", r"^(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|.*\.local)$", "true"),
    ]
    pick = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(host, '{x[2]}') THEN {x[k] if k == 3 else repr(x[k])}" for x in sites) + " END"
    lazy = " ".join(f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN 'host:{h}'" for h in LAZY_HOSTS)
    chat = f"h AS (SELECT *, {host} AS host, CASE WHEN {path} = '' THEN '/' ELSE {path} END AS path FROM u), c AS (SELECT *, {pick(0)} AS site, {pick(1)} AS label, {pick(3)} AS thread, CASE {lazy} END AS lazy FROM h)"
    entity = "title"
    for name, char in NAMED_ENTITIES:
        entity = f"replace({entity}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    title = rf"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    # In the fixture no title has numeric entities.
    titles = f"SELECT page_id, {_trim(f"regexp_replace({entity}, '[{WS}]+', ' ', 'g')")} AS title FROM (SELECT page_id, regexp_replace({title}, '<[^>]*>', ' ', 'g') AS title FROM pages)"
    cand = f"""WITH {url_parts}, c AS (SELECT page_id % 10 AS query_id, url, host, path, query, floor(page_id / 10 + 1)::INT AS engine_rank,
  host || regexp_replace(path, '/+$', '') || query AS key, regexp_matches(path || full_query, '(?i)\\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz|mp[34]|avi|mov|webm|jpe?g|png|gif|svg|webp|epub|csv)(\\?|#|$)') AS file FROM p),
k AS (SELECT *, row_number() OVER w AS r, first_value(key) OVER w AS first_key FROM c WHERE NOT file WINDOW w AS (PARTITION BY query_id, host ORDER BY engine_rank, url)),
g AS (SELECT query_id, url, host, engine_rank, path, query, regexp_extract(url, '(#.*)', 1) AS fragment, split_part(url, ':', 1) AS scheme, (20 - engine_rank
  + CASE WHEN regexp_matches(host, '\\.(gov|edu|ac\\.uk)$|^docs\\.') THEN 6 ELSE 0 END
  + CASE WHEN len(list_filter(string_split(path, '/'), lambda s: s <> '')) >= 2 AND query = '' THEN 3 ELSE 0 END
  - CASE WHEN regexp_matches(path || query, '/tag/|/category/|/search\\?|/page/[0-9]') THEN 5 ELSE 0 END) AS score FROM k WHERE r = 1)"""
    groups = "sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)"
    exchange = f"""WITH a AS (SELECT *, {groups} AS u FROM conversations WHERE role IN ('user', 'assistant')),
x AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' OR u = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS exchange FROM a)"""
    shingles = f"""w AS (SELECT doc_id, {_words(f"regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{FENCE}', ' ', 'g'), '{LINK}', '\\1', 'g')), '[^a-z0-9{WS}]', ' ', 'g')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS k FROM w WHERE len(w) >= 6))"""
    classes = """sets AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS key, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS class_id FROM sets)"""
    pairs = """heads AS (SELECT sh.doc_id, s FROM sh JOIN cls USING (doc_id) WHERE doc_id = class_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM heads x JOIN heads y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)"""
    name = "regexp_replace(regexp_replace(regexp_replace(substr(coalesce(text, ''), 1, 160), '[<>:\"/\\\\|?*\\x00-\\x1F]', '', 'g'), '[\\s.]+', '_', 'g'), '_+', '_', 'g')"
    name = f"regexp_replace(substr(regexp_replace({name}, '^_+|_+$', '', 'g'), 1, 100), '_+$', '')"
    est = f"ceil(greatest(len({_words('coalesce(text, $$$$)')}) * 0.75, (len(coalesce(text, '')) + len(regexp_extract_all(coalesce(text, ''), '[\\x{{10000}}-\\x{{10FFFF}}]'))) / 4))::BIGINT"
    return {
        "quality_stats": stats,
        "quality_score": score,
        "quality_reasons": f"{points(QUESTION)} SELECT points::INT AS points, ord::BIGINT AS ord, count(*) AS n FROM r WHERE points IS NOT NULL GROUP BY points, ord",
        "dup_lines": f"WITH {_stats('')} SELECT doc_id, round(dups / n_lines, 9) AS share FROM m WHERE dups > 0",
        "query_overlap": f"WITH {_stats(QUESTION)} SELECT doc_id, matched::BIGINT AS matched, round(CASE WHEN n_terms > 0 THEN matched / n_terms ELSE 1.0 END, 9) AS overlap FROM m",
        "token_estimate": f"SELECT doc_id, {est} AS tokens FROM documents",
        "token_heuristic": f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 + coalesce(list_sum(list_transform(regexp_extract_all(text, '{pieces}'), lambda p: greatest(1, ceil(strlen(p) / 4)))), 0) END::BIGINT AS tokens FROM documents",
        "token_limit": f"WITH t AS (SELECT doc_id, {est} AS t FROM documents) SELECT doc_id, floor(t * 1000 / 4096 + 0.5) / 10 AS percentage, t > 4096 AS over, greatest(0, 4096 - t)::BIGINT AS remaining, format('{{:,}}', t) || ' tokens' AS label, CASE WHEN t > 4096 THEN 'file' ELSE 'clipboard' END AS route FROM t",
        "url_normalize": f"WITH {url_parts} SELECT page_id, host, path, query, host || regexp_replace(path, '/+$', '') || query AS key, split_part(url, ':', 1) || '://' || www || path || query || regexp_extract(url, '(#.*)', 1) AS clean, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::BIGINT AS depth, regexp_matches(path || full_query, '(?i)\\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz|mp[34]|avi|mov|webm|jpe?g|png|gif|svg|webp|epub|csv)(\\?|#|$)') AS file, regexp_matches(path || full_query, '/tag/|/category/|/search\\?|/page/[0-9]') AS low_value FROM p",
        "url_private_guard": f"""WITH {url_parts}, a AS (SELECT page_id, page_id % 256 AS a, floor(page_id / 7 % 256)::INT AS b, www, url FROM p)
SELECT page_id, url, '' AS refused FROM a UNION ALL SELECT page_id, 'http://' || www || '.local/', 'Refused: this URL points at a private address' FROM a
UNION ALL SELECT page_id, 'http://' || a || '.' || b || '.0.1/', CASE WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) THEN 'Refused: this URL points at a private address' ELSE '' END FROM a""",
        "url_route": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'reddit' WHEN 1 THEN 'x' WHEN 2 THEN 'github' WHEN 3 THEN 'youtube' ELSE 'discord' END AS site, CASE page_id % 5 WHEN 0 THEN 'post' WHEN 1 THEN 'post' WHEN 2 THEN 'repository' WHEN 3 THEN 'video' ELSE 'channel' END AS page_type FROM pages",
        "chat_route": f"WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, list_value({shapes})[page_id % {len(CHAT_SHAPES)} + 1] || page_id FROM pages), {chat} SELECT page_id, url, site, label, thread, lazy FROM c",
        "chat_probe": f"""WITH k AS (SELECT DISTINCT conv_id FROM conversations), u AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN list_value({shapes})[conv_id % {len(CHAT_SHAPES)} + 1] || conv_id ELSE 'https://forum.example.org/t/' || conv_id END AS url FROM k), {chat},
t AS (SELECT conv_id, coalesce(role IN ('user', 'assistant'), false) AS said, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations),
f AS (SELECT conv_id, k, said, CASE WHEN said THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM t),
n AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (said) AS said, count(*) FILTER (role = 'user') + CASE WHEN arg_min(role, k) = 'user' THEN 0 ELSE coalesce(min(k) FILTER (role = 'user'), max(k) + 1) - 1 END AS exchanges FROM f GROUP BY conv_id)
SELECT conv_id, site, coalesce(label, host) AS label, turns, exchanges::BIGINT AS exchanges, coalesce(thread AND (site IN ('claude', 'chatgpt', 'google-ai') OR turns >= 2), false) OR (turns >= 4 AND 2 * said >= turns) AS is_chat FROM c JOIN n USING (conv_id)""",
        "discovery_rank": f"{cand}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, engine_rank, url) AS pos FROM g) SELECT query_id, scheme || '://' || regexp_extract(url, '://([^/?#]*)', 1) || path || query || fragment AS url, host, engine_rank::BIGINT AS engine_rank, CASE WHEN pos <= 8 THEN 'result' ELSE 'reserve' END AS disposition, score::BIGINT AS score, pos FROM o",
        "discovery_reject_reasons": f"{cand} SELECT query_id, CASE WHEN key = first_key THEN 'Duplicate URL' ELSE 'Duplicate host' END AS reason, count(*) AS n FROM k WHERE r > 1 GROUP BY 1, 2 UNION ALL SELECT query_id, 'Not a web page', count(*) FROM c WHERE file GROUP BY query_id",
        "chat_exchanges": f"{exchange} SELECT conv_id, turn, role, exchange FROM x",
        "chat_last_n": f"{exchange} SELECT conv_id, turn, exchange FROM x QUALIFY exchange > max(exchange) OVER (PARTITION BY conv_id) - 2",
        "chat_transcript": f"{exchange} SELECT conv_id, count(DISTINCT exchange) AS exchanges, count(*) AS messages, sha256(string_agg('### ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS body_sha256 FROM x GROUP BY conv_id",
        "author_carry": "SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), '') AS author FROM events",
        "self_thread": "WITH a AS (SELECT conv_id AS thread_id, turn AS seq, role <> first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations) SELECT thread_id, seq, CASE WHEN max(other::INT) OVER (PARTITION BY thread_id ORDER BY seq) = 0 THEN 'thread' ELSE 'reply' END AS part FROM a",
        "first_n": "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) > 3 AS truncated FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3",
        "file_tree": f"WITH {url_parts}, f AS (SELECT DISTINCT host AS repo, list_filter(string_split(path, '/'), lambda s: s <> '') AS l FROM p), n AS (SELECT repo, array_to_string(l[1:k], '/') AS path, max(k < len(l)) AS is_dir FROM (SELECT repo, l, unnest(range(1, len(l) + 1)) AS k FROM f) GROUP BY 1, 2) SELECT repo, count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS dirs FROM n GROUP BY repo",
        "active_branch": "WITH RECURSIVE top AS (SELECT conv_id, max(turn) AS node_id FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, node_id, 0 AS depth FROM top UNION ALL SELECT b.conv_id, c.turn, depth + 1 FROM b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = floor(b.node_id / 2)::BIGINT WHERE b.node_id > 0) SELECT conv_id, node_id, depth::BIGINT AS depth FROM b",
        # Replies of deleted comments rise into their place; a level at a time.
        "comment_paths": """WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn > 0 THEN floor(turn / 2)::BIGINT END AS parent, turn % 3 = 1 AS gone FROM conversations),
t AS (SELECT conv_id, turn, lpad(turn::VARCHAR, 9, '0') AS sort, NULL::BIGINT AS up, gone FROM c WHERE parent IS NULL
  UNION ALL SELECT c.conv_id, c.turn, t.sort || '.' || lpad(c.turn::VARCHAR, 9, '0'), CASE WHEN t.gone THEN t.up ELSE t.turn END, c.gone FROM c JOIN t ON c.conv_id = t.conv_id AND c.parent = t.turn),
live AS (SELECT *, row_number() OVER (PARTITION BY conv_id, up ORDER BY sort) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY sort) AS ord FROM t WHERE NOT gone),
p AS (SELECT conv_id, turn, n::VARCHAR AS path, ord FROM live WHERE up IS NULL UNION ALL SELECT l.conv_id, l.turn, p.path || '.' || l.n, l.ord FROM live l JOIN p ON l.conv_id = p.conv_id AND l.up = p.turn)
SELECT conv_id AS post_id, turn::VARCHAR AS id, path, ord::BIGINT AS ord FROM p""",
        "shingle_counts": f"WITH {shingles}, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id) SELECT doc_id, coalesce(n, 0)::BIGINT AS shingles FROM documents LEFT JOIN n USING (doc_id)",
        "near_dup_members": f"WITH {shingles}, {classes} SELECT doc_id, class_id FROM cls",
        "near_dup_pairs": f"WITH {shingles}, {classes}, {pairs} SELECT a, b, shared::BIGINT AS shared, (x.n + y.n - shared)::BIGINT AS total FROM pr JOIN cls x ON x.doc_id = a JOIN cls y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)",
        # Of each class the first that is not junk speaks; speakers are taken in the order of ids, each accepted unless a similar one was before it.
        "near_dup_gate": f"""WITH RECURSIVE scored AS ({score}), {shingles}, {classes}, {pairs},
alike AS MATERIALIZED (SELECT a, b FROM pr JOIN cls x ON x.doc_id = a JOIN cls y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
eitherway AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
named AS MATERIALIZED (SELECT doc_id, class_id, verdict = 'reject' AS junk FROM cls JOIN scored USING (doc_id)),
speaker AS MATERIALIZED (SELECT class_id, min(doc_id) AS id FROM named WHERE NOT junk GROUP BY class_id),
links AS MATERIALIZED (SELECT x.id AS earlier, y.id AS later FROM eitherway JOIN speaker x ON x.class_id = a JOIN speaker y ON y.class_id = b WHERE x.id < y.id),
turns AS MATERIALIZED (SELECT later, row_number() OVER (ORDER BY later) AS k FROM (SELECT DISTINCT later FROM links)),
walk(k, refused) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT t.k, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.later = t.later AND NOT list_contains(w.refused, l.earlier)) THEN list_append(w.refused, t.later) ELSE w.refused END
  FROM walk w JOIN turns t ON t.k = w.k + 1),
refused AS (SELECT unnest(refused) AS id FROM (SELECT refused FROM walk ORDER BY k DESC LIMIT 1)),
accepted AS (SELECT class_id, id FROM speaker WHERE id NOT IN (SELECT id FROM refused)),
reach AS (SELECT class_id, id FROM accepted UNION ALL SELECT b, id FROM eitherway JOIN accepted ON class_id = a),
first_met AS (SELECT n.doc_id, min(id) AS named FROM named n JOIN reach USING (class_id) WHERE id < n.doc_id GROUP BY n.doc_id)
SELECT doc_id, CASE WHEN named IS NOT NULL THEN 'duplicate' WHEN verdict = 'reject' THEN 'junk' ELSE 'accepted' END AS disposition, named
FROM scored LEFT JOIN first_met USING (doc_id)""",
        # Pairs within a run; each document in turn is a duplicate if an accepted one before it is similar.
        "stream_gate": f"""WITH RECURSIVE {shingles}, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id AND x.doc_id // 50 = y.doc_id // 50 GROUP BY 1, 2),
d AS MATERIALIZED (SELECT doc_id, coalesce(length(text), 0) < 200 AS junk FROM documents),
links AS MATERIALIZED (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b JOIN d ON d.doc_id = a WHERE 100 * shared >= 75 * (x.n + y.n - shared) AND NOT junk),
turns AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) AS k FROM (SELECT DISTINCT b FROM links)),
walk(k, refused) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT t.k, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.b = t.b AND NOT list_contains(w.refused, l.a)) THEN list_append(w.refused, t.b) ELSE w.refused END FROM walk w JOIN turns t ON t.k = w.k + 1),
refused AS MATERIALIZED (SELECT unnest(refused) AS id FROM (SELECT refused FROM walk ORDER BY k DESC LIMIT 1)),
met AS (SELECT b AS doc_id, min(a) AS named FROM links WHERE a NOT IN (SELECT id FROM refused) GROUP BY b)
SELECT doc_id, (doc_id // 50)::VARCHAR AS run, CASE WHEN named IS NOT NULL THEN 'duplicate' WHEN junk THEN 'junk' ELSE 'accepted' END AS disposition, named FROM d LEFT JOIN met USING (doc_id)""",
        # A list ends with its 15th item, with a pass after two without news, or with one that begins too late.
        "stream_harvest": f"""WITH e AS (SELECT user_id, event_id AS seq, ts, (ts::DATE - DATE '1970-01-01')::BIGINT AS pass, event_type || ':' || floor(value / 10)::BIGINT AS key FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY pass, seq) = 1 AS fresh FROM e),
p AS (SELECT user_id, pass, count(*) FILTER (fresh) AS added, arg_min(ts, seq) AS t FROM f GROUP BY user_id, pass),
q AS (SELECT *, max(CASE WHEN added > 0 THEN pass END) OVER (PARTITION BY user_id ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_new, first_value(t) OVER (PARTITION BY user_id ORDER BY pass) AS t0 FROM p),
cut AS (SELECT user_id, min(pass) FILTER (pass - last_new - 1 >= 2) AS idle_pass, min(pass) FILTER (epoch_ms(t) > epoch_ms(t0) + {HARVEST_SECONDS * 1000}) AS late_pass FROM q GROUP BY user_id),
items AS (SELECT user_id, key, pass, row_number() OVER (PARTITION BY user_id ORDER BY pass, seq) AS pos FROM f JOIN cut USING (user_id) WHERE fresh AND pass < coalesce(least(idle_pass, late_pass), pass + 1)),
ends AS (SELECT user_id, max(pass) FILTER (pos = 15) AS full_pass FROM items GROUP BY user_id)
SELECT user_id::VARCHAR AS list, key, pos, pass, NULL AS ended FROM items WHERE pos <= 15
UNION ALL SELECT user_id::VARCHAR, NULL, NULL, coalesce(full_pass, least(idle_pass, late_pass)), CASE WHEN full_pass IS NOT NULL THEN 'limit' WHEN idle_pass <= coalesce(late_pass, idle_pass) THEN 'idle' ELSE 'deadline' END
FROM cut JOIN ends USING (user_id) WHERE full_pass IS NOT NULL OR idle_pass IS NOT NULL OR late_pass IS NOT NULL""",
        # What the table of decisions says of six kinds of responses; no fixture page holds a challenge.
        "response_classify": """SELECT page_id AS source_id, list_value('html', 'nonHtml', 'httpError', 'httpError', 'text', 'html')[page_id % 6 + 1] AS kind,
  list_value('use', 'reject', 'reject', 'render', 'render', 'use')[page_id % 6 + 1] AS decision,
  list_value(NULL, 'PDFs open in the browser''s viewer, where extensions cannot run', 'Server answered 404: the page is not there, and a tab cannot bring it back',
    'Server answered 403, so a tab was opened', 'Server answered 503, so a tab was opened', NULL)[page_id % 6 + 1] AS reason,
  list_value(NULL, 'unusable', 'unusable', 'transient', 'transient', NULL)[page_id % 6 + 1] AS category FROM pages""",
        "html_title": titles,
        "file_names": f"SELECT doc_id, CASE WHEN {name} = '' THEN 'untitled' ELSE {name} END AS name FROM documents",
        "unique_file_names": """WITH d AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'note ' || coalesce(lang, '') WHEN 1 THEN 'note ' || coalesce(lang, '') || ' ' || doc_id % 9
  WHEN 2 THEN 'note.' || coalesce(lang, '') || '_1_' || doc_id % 5 ELSE 'note <' || coalesce(lang, '') || '> 0' || doc_id % 3 END AS title FROM documents),
b AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids, list([rtrim(regexp_replace(regexp_replace(title, '[<>]', '', 'g'), '[ ._]+', '_', 'g'), '_')] ORDER BY doc_id) AS bases FROM d GROUP BY source),
n AS (SELECT source, ids, list_reduce(bases, lambda used, x: list_append(used, CASE WHEN NOT list_contains(used, x[1]) THEN x[1]
  ELSE x[1] || '_' || list_filter(range(1, len(used) + 2), lambda k: NOT list_contains(used, x[1] || '_' || k))[1] END), []::VARCHAR[]) AS names FROM b)
SELECT unnest(ids) AS doc_id, source, unnest(names) || '.md' AS name FROM n""",
        "archived_conversations": """SELECT conv_id % 16 AS batch, role || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || '.md' AS name, strlen(t) AS bytes, strlen(t) > 1000 AS too_large,
  CASE WHEN strlen(t) <= 1000 THEN sha256(t) END AS body_sha256
FROM (SELECT conv_id, role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id % 16, role ORDER BY conv_id * 1000 + turn) AS n FROM conversations WHERE role <> 'system')""",
        "archived_pages": f"""WITH {url_parts} SELECT page_id, p.host, strlen(t) AS bytes, strlen(t) > 1000 AS too_large, CASE WHEN strlen(t) <= 1000 THEN sha256(t) END AS body_sha256
FROM p JOIN (SELECT page_id, coalesce(html, '') AS t FROM pages) USING (page_id)""",
        "message_markdown": rf"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id * 7 + turn) % 10 AS k, chr(10) AS nl, chr(10) || chr(10) AS gap FROM conversations),
r AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: len(x))), 0) AS ticks FROM c),
f AS (SELECT *, repeat('`', greatest(ticks, 2)::INT + 1) AS fence, repeat('`', greatest(ticks, 4)::INT + 1) AS fence5, {_trim("t")} AS u FROM r),
m AS (SELECT conv_id, turn, CASE k
  WHEN 0 THEN CASE WHEN u = '' THEN '' ELSE '<details>' || nl || '<summary>Reading</summary>' || gap || '- Weighing' || gap || u || gap || '_(cut off)_' || gap || '</details>' || gap || u END
  WHEN 1 THEN '**Wrote a file**' || gap || fence5 || 'py' || nl || t || nl || '````' || nl || fence5
  WHEN 2 THEN '**search**: ' || q || ' ``' || t || ' ' || q
  WHEN 3 THEN '**make — Notes**' || gap || fence || 'md' || nl || 'x' || t || nl || fence
  WHEN 4 THEN '**Sources**' || gap || '- [A page](https://x.org/p) — X' || nl || '- [https://x.org/q](https://x.org/q)'
  WHEN 5 THEN '**Result**' || gap || fence || nl || 'o' || t || nl || fence || gap || '_stderr_' || gap || fence || nl || 'e' || regexp_replace(t, '\n$', '') || nl || fence
  WHEN 6 THEN '**Result**' || gap || '_exit code 3, no output_' || gap || '**Result (failed)**' || gap || fence || nl || '{{not json ' || t || nl || fence
  WHEN 7 THEN {_trim("'x' || t")} || gap || '- image: [a.png](https://x.org/a)' || nl || '- attached: b.txt' || nl || '- attached: c.csv'
  WHEN 8 THEN 'x' || t || ' y' || gap || '- image: [a.png](https://x.org/a)' || nl || '- attached: b.txt'
  ELSE '**Tool**' || gap || '```json' || nl || '{{"a":true,"b":5}}' || nl || '```' END AS md
  FROM (SELECT *, repeat('`', greatest(ticks, 2)::INT + 1) AS q FROM f))
SELECT conv_id, turn, sha256(md) AS markdown_sha256, length(md) AS n FROM m""",
        "listing_tokens": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'c' || page_id WHEN 1 THEN 'd' || page_id END AS section,
  CASE page_id % 4 WHEN 0 THEN 'r' || page_id WHEN 1 THEN 'first' || page_id END AS following FROM pages""",
        "merged_documents": "SELECT conv_id, count(*) AS n, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS document_sha256 FROM conversations WHERE role <> 'system' GROUP BY conv_id",
        "run_snapshot": """WITH e AS (SELECT user_id AS run_id, list_value('ok', 'error', 'skipped', 'pending')[event_id % 4 + 1] AS status, list_value('quiet', 'tab')[event_id % 2 + 1] AS path, list_value(NULL, 'junk', 'wall')[event_id % 3 + 1] AS category, floor(value)::BIGINT AS tokens FROM events)
SELECT run_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'fetching') AS fetching, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'ok' AND path = 'quiet') AS quiet, count(*) FILTER (status = 'ok' AND path = 'tab') AS rendered, count(*) FILTER (category IN ('junk', 'duplicate')) AS dropped, 0::BIGINT AS replacements,
  count(*) FILTER (status IN ('ok', 'error', 'skipped')) AS completed, coalesce(sum(tokens) FILTER (status = 'ok'), 0)::BIGINT AS tokens FROM e GROUP BY run_id""",
    }
