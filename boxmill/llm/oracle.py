"""SQL twins of the numbered queries that SQL can express."""

from __future__ import annotations

from boxmill.llm import bit_planes, spelling
from boxmill.llm.mixing import MAX_COPIES, SEED, WEIGHTS
from boxmill.llm.substring_dedup import EDGE_WORDS, MIN_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Pieces cover the whole text, so their lengths give offsets; pieces without a word are no units. Units of two kinds with the same
# span (blanks at the ends aside) are one.
_SUBSTRINGS = rf"""
WITH pieces AS (
    SELECT doc_id, kind, k, p[k] AS piece,
        CAST(coalesce(sum(len(p[k])) OVER (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, kind, p, unnest(range(1, len(p) + 1)) AS k FROM (
        SELECT doc_id, 'sentence' AS kind, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?\n]+') AS p FROM documents
        UNION ALL SELECT doc_id, 'line', regexp_extract_all(text, '[^\n]+|\n+') FROM documents
        UNION ALL SELECT doc_id, 'paragraph', regexp_extract_all(text, '[^\n]+(?:\n[^\n]+)*|\n+') FROM documents))
), units AS (
    SELECT doc_id, kind, start, start + len(piece) AS stop, start + len(piece) - len(ltrim(piece, {_BLANKS})) AS a, start + len(rtrim(piece, {_BLANKS})) AS b,
        row_number() OVER (PARTITION BY doc_id, kind ORDER BY k) AS unit, w, array_to_string(w, ' ') AS normal
    FROM (SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM pieces WHERE regexp_matches(piece, CASE kind WHEN 'sentence' THEN '^[^.!?\n]' ELSE '^[^\n]' END))
    WHERE len(w) > 0
), sentences AS (
    SELECT doc_id, start, CASE WHEN len(w) >= {EDGE_WORDS} THEN array_to_string(w[-{EDGE_WORDS}:], ' ') END AS tail,
        CASE WHEN len(w) >= {EDGE_WORDS} THEN array_to_string(w[:{EDGE_WORDS}], ' ') END AS head
    FROM units WHERE kind = 'sentence'
), spans AS (
    SELECT DISTINCT u.doc_id, a, b, normal, p.tail AS before, n.head AS after FROM units u
    ASOF LEFT JOIN sentences p ON u.doc_id = p.doc_id AND u.start > p.start
    ASOF LEFT JOIN sentences n ON u.doc_id = n.doc_id AND u.stop <= n.start
), marked AS (
    SELECT doc_id, a, b, row_number() OVER o > 1 AS repeated, coalesce(CAST(before = first_value(before) OVER o AS INTEGER), 0) AS same_before,
        coalesce(CAST(after = first_value(after) OVER o AS INTEGER), 0) AS same_after
    FROM spans WINDOW o AS (PARTITION BY normal ORDER BY doc_id, a)
), runs AS (
    SELECT DISTINCT doc_id, min(start) AS start, max(stop) AS stop
    FROM (SELECT u.*, same_before, same_after, unit - row_number() OVER (PARTITION BY doc_id, kind ORDER BY unit) AS run
          FROM units u JOIN marked USING (doc_id, a, b) WHERE repeated)
    GROUP BY doc_id, kind, run HAVING sum(len(w)) + {EDGE_WORDS} * (arg_min(same_before, unit) + arg_max(same_after, unit)) >= {MIN_WORDS}
), merged AS (
    SELECT doc_id, min(start) AS start, max(stop) AS stop
    FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
                FROM runs))
    GROUP BY doc_id, island
), gone AS (
    SELECT s.doc_id, count(*) AS n_removed FROM spans s JOIN merged m ON s.doc_id = m.doc_id AND s.a >= m.start AND s.b <= m.stop GROUP BY s.doc_id
), cut AS (
    SELECT doc_id, sum(stop - start) AS removed_chars, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans,
        string_agg(substr(text, before + 1, start - before), '' ORDER BY start) AS head, max(stop) AS last
    FROM (SELECT m.*, d.text, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM merged m JOIN documents d USING (doc_id))
    GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(u.n, 0) AS INTEGER) AS n_units, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
    CAST(coalesce(removed_chars, 0) AS INTEGER) AS removed_chars, coalesce(spans, '') AS removed_spans,
    CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS text
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) u USING (doc_id)
LEFT JOIN gone USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

# Windows are joined as texts, one length at a time, over every word position of every document.
_DECONTAMINATION = rf"""
WITH items AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
    SELECT doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE len(w) > 0), (SELECT DISTINCT width FROM windows)
    WHERE i + width - 1 <= len(w)
), hits AS (
    SELECT doc_id, i, p.width, item_id FROM places p JOIN windows v ON p.win = v.win AND p.width = v.width
), words AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, {MAX_COPIES} * source_size AS cap,
        ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
    FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), plan AS (
    SELECT source, source_size,
        coalesce(least(CAST(cap AS DOUBLE), max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight), 0) AS target,
        CAST('0x' || substr(md5('{SEED}/' || coalesce(source, chr(0))), 1, 8) AS BIGINT) / 4294967296 AS start
    FROM levels
), ranked AS (
    SELECT doc_id, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
        row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS FIRST) AS place
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
    size * CAST(floor(ratio * place + start) - floor(ratio * (place - 1) + start) AS BIGINT) AS taken
FROM ranked
"""



def _clusters() -> str:
    """Centroids of every round as one table each."""
    steps = []
    for r in range(1, bit_planes.ROUNDS + 1):
        steps.append(f"""nearest{r} AS MATERIALIZED ({_nearest(f"centroids{r - 1}")}),
    sums{r} AS (SELECT k, pos, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS pos, unnest(c) AS x FROM nearest{r}) GROUP BY k, pos),
    centroids{r} AS MATERIALIZED (
        SELECT o.k, coalesce(m.c, o.c) AS c FROM centroids{r - 1} o LEFT JOIN
            (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM sums{r} GROUP BY k) m USING (k))""")
    return f"""
WITH vectors AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({bit_planes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
    WHERE len(embedding) = {bit_planes.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {bit_planes.COMPONENTS}
), centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS k, c FROM (SELECT sha256('{bit_planes.SEED}:' || vec_id) AS h, c FROM vectors ORDER BY h LIMIT {bit_planes.CLUSTERS})
), {", ".join(steps)}, assigned AS MATERIALIZED ({_nearest(f"centroids{bit_planes.ROUNDS}")})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.c, ',')) AS centroid_sha256
FROM assigned JOIN centroids{bit_planes.ROUNDS} f USING (k)
"""


def _nearest(centroids: str) -> str:
    return f"""SELECT vec_id, c, k, d FROM (
        SELECT v.vec_id, v.c, m.k, list_sum(list_transform(list_zip(v.c, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM vectors v, {centroids} m)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1"""


_EXACT = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""

# The CRC-32 takes eight steps per byte; near words share a form with one code point deleted.
_SPELLING = f"""
WITH RECURSIVE runs AS (
    SELECT label, run, count(*) AS n FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS label, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE len(run) >= {spelling.MIN_LENGTH} GROUP BY label, run
), coded AS (
    SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(0, strlen(label || run)),
        lambda i: [CAST('0x' || substr(hex(encode(label || run)), 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) // 2, 3988292384) ELSE xor(a, b) // 2 END), 4294967295) AS h
    FROM runs
), words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM coded)
    WHERE len(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
), cut AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.FORM_RATIO} * w.n THEN near END AS form,
        CASE WHEN near_n >= {spelling.FORM_RATIO} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word
)
SELECT f.word, form, c.root, f.n, n_near, form_n FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""

ORACLE = {
    "op1_substring_dedup": _SUBSTRINGS,
    "op6_benchmark_decontamination": _DECONTAMINATION,
    "op7_source_mixing": _MIXING,
    "op11_bit_planes": _clusters(),
    "op12_content_sort": _EXACT,
    "op13_spelling_variants": _SPELLING,
}
