"""DuckDB SQL with the rows of the queries that SQL can express."""

#: A-Z in small letters, all else as it stands.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS s FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, s, array_to_string(w[k:k + s - 1], ' ') AS g
       FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM sized)),
sizes AS (SELECT DISTINCT s FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(w[k:k + s - 1], ' ') AS g
       FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM d, sizes)),
hits AS (SELECT doc_id, k, s, item_id FROM dw JOIN iw USING (s, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(k, k + s)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
           FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y
          WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d
          UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM d LEFT JOIN sized USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS least_id FROM reach GROUP BY x) USING (doc_id)
"""

#: By positions in the text, without lists of units; what is restored is the text itself.
FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def centroids(rounds: int = 3, k: int = 16) -> str:
    """Every vector against every centroid in every round, without trees."""
    parts = [rf"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(v, lambda y: floor(64 * y)::BIGINT) AS v FROM e
      WHERE len(v) = 64 AND len(list_filter(v, lambda y: isfinite(y))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM x QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        parts.append(rf"""
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
      FROM (SELECT r, c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, c{i} m) GROUP BY r)""")
        if i < rounds:
            parts.append(rf"""
s{i} AS (SELECT c, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS y, unnest(range(1, 65)) AS j FROM a{i} JOIN x USING (r)) GROUP BY c, j),
f{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(f.v, m.v) AS v FROM c{i} m LEFT JOIN f{i} f USING (c))""")
    return ",".join(parts) + rf"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN c{rounds} m USING (c)
"""


def license_scan() -> str:
    """Every template at every beginning, without the index: what the scan must find."""
    from marginalia.llm.license_scan import _VOCABULARY, BASE, COVER, TEMPLATES

    base = ", ".join(f"('{p}', '{label}')" for p, label in BASE)
    posted = ", ".join(f"({i}, '{label}', {t}, '{w}')" for i, (label, notice, _) in enumerate(TEMPLATES) for t, w in enumerate(notice.split()) if w in _VOCABULARY)
    keys = ", ".join(f"({i}, '{k}')" for i, (_, _, own) in enumerate(TEMPLATES) for k in own)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
base(phrase, label) AS (VALUES {base}),
posted(tid, label, t, word) AS (VALUES {posted}),
keys(tid, phrase) AS (VALUES {keys}),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
places AS (SELECT doc_id, label, k - 1 AS p FROM words JOIN base
           ON array_to_string(w[k:k + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
hits AS (SELECT doc_id, tid, label, k - 1 - t AS begin, count(DISTINCT t) AS n
         FROM words JOIN posted ON w[k] = word GROUP BY doc_id, tid, label, k - 1 - t),
sizes AS (SELECT tid, count(*) AS size FROM posted GROUP BY tid),
good AS (SELECT doc_id, label, tid, max(n / size) AS cover FROM hits JOIN sizes USING (tid)
         GROUP BY doc_id, label, tid HAVING max(n / size) >= {COVER}),
proven AS (SELECT DISTINCT doc_id, g.label, cover FROM good g JOIN d USING (doc_id) JOIN keys USING (tid)
           WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS cover
           FROM (SELECT doc_id, label, cover FROM proven UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE, 6) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
