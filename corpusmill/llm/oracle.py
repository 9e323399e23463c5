"""DuckDB equivalents of the queries that SQL can express; the others are held against brute force in the tests."""

from .quality import FALLBACK, GAMMA, LEAST_DOCS, SPREAD

#: What one event adds to a document of the median size.
_EVENTS = {"symbol_share": "1 / {word_chars}", "dup_line_share": "1 / {n_lines}", "repeat_share": "16 / {n_words}", "mean_word": "1 / {n_words}"}
_SIZES = ["n_lines", "n_words", "word_chars"]

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM r
"""

_FEATURES = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest(generate_series(0, 7)) AS u(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_unlike,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN hit USING (doc_id)),
b AS (
  SELECT *, n_lines - n_unlike AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN (n_lines - n_unlike) / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word
  FROM f)
"""


def _quality() -> str:
    """The base features, the sketches of logarithmic buckets, their quantiles and the verdict."""
    long = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM b WHERE NOT base_failed" for f in [*FALLBACK, *_SIZES])
    quartiles = ", ".join(f"min(CASE WHEN upto > floor((docs - 1) * {k} / 4.0) THEN CASE WHEN bucket = -1000000 THEN 0.0 ELSE 2 * pow({GAMMA!r}, bucket) / ({GAMMA!r} + 1) END END) AS q{k}" for k in (1, 2, 3))

    def quantiles(by: str) -> str:
        keys = f"{by}, " if by else ""
        sizes = ", ".join(f"max(CASE WHEN feature = '{z}' THEN q2 END) OVER ({f'PARTITION BY {by}' if by else ''}) AS {z}" for z in _SIZES)
        return f"SELECT *, {sizes} FROM (SELECT {keys}feature, first(docs) AS docs, {quartiles} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}feature) AS docs FROM (SELECT {keys}feature, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}feature)"

    pick = {q: f"CASE WHEN o.docs >= {LEAST_DOCS} THEN o.{q} WHEN l.docs >= {LEAST_DOCS} THEN l.{q} ELSE e.{q} END" for q in ("q1", "q2", "q3", *_SIZES)}
    enough = f"(o.docs >= {LEAST_DOCS} OR coalesce(l.docs >= {LEAST_DOCS}, false))"
    low, high = [], []
    for f, (lo, hi) in FALLBACK.items():
        reach = f"{SPREAD} * greatest({pick['q3']} - {pick['q1']}, {_EVENTS[f].format(**pick)}, 0.02 * {pick['q2']})"
        below, above = f"round({pick['q2']} - {reach}, 9)", f"round({pick['q2']} + {reach}, 9)"
        if lo is not None:
            low.append(f"WHEN o.feature = '{f}' THEN CASE WHEN {enough} THEN {below} ELSE least({lo}, {below}) END")
        high.append(f"WHEN o.feature = '{f}' THEN CASE WHEN {enough} THEN {above} ELSE greatest({hi}, {above}) END")
    good = " AND ".join(f"coalesce(b.{f} <= (SELECT high FROM lim WHERE feature = '{f}' AND lang IS NOT DISTINCT FROM b.lang AND source IS NOT DISTINCT FROM b.source), true) AND coalesce(b.{f} >= (SELECT low FROM lim WHERE feature = '{f}' AND lang IS NOT DISTINCT FROM b.lang AND source IS NOT DISTINCT FROM b.source), true)" for f in FALLBACK)
    return f"""{_FEATURES},
long AS ({long}),
sketch AS (SELECT lang, source, feature, CASE WHEN x > 0 THEN CAST(ceil(round(ln(x) / ln({GAMMA!r}), 6)) AS INTEGER) ELSE -1000000 END AS bucket, count(*) AS n FROM long GROUP BY ALL),
o AS ({quantiles("lang, source")}), l AS ({quantiles("lang")}), e AS ({quantiles("")}),
lim AS (SELECT o.lang, o.source, o.feature, CASE {' '.join(low)} END AS low, CASE {' '.join(high)} END AS high
  FROM o LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.feature = l.feature LEFT JOIN e ON o.feature = e.feature)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {good} AS kept FROM b
"""


JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS u(i)),
sets AS (SELECT doc_id, count(*) AS n, bit_xor(hash(s)) AS h1, bit_xor(hash(s || '#')) AS h2 FROM g GROUP BY doc_id),
stands AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h1, h2) AS node FROM sets),
own AS (SELECT g.doc_id AS node, s, n FROM g JOIN stands USING (doc_id) WHERE g.doc_id = node),
links AS (
  SELECT x.node AS a, y.node AS b FROM own x JOIN own y ON x.s = y.s AND x.node < y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS top FROM (SELECT DISTINCT node FROM stands) UNION SELECT ends.b, reach.top FROM reach JOIN ends ON ends.a = reach.node),
tops AS (SELECT node, min(top) AS top FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(stands.n, 0) AS BIGINT) AS n_shingles, coalesce(tops.top, w.doc_id) AS component_id
FROM w LEFT JOIN stands USING (doc_id) LEFT JOIN tops ON tops.node = stands.node
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
q AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
cut AS (SELECT item_id, ws[i:i + 12] AS win FROM q, unnest(generate_series(1, greatest(len(ws) - 12, least(len(ws), 1)))) AS u(i)),
wins AS (SELECT win, len(win) AS n, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM cut GROUP BY win),
terms AS (SELECT doc_id, i - 1 AS pos, ws[i] AS term FROM d, unnest(generate_series(1, len(ws))) AS u(i)),
vocab AS (SELECT DISTINCT unnest(win) AS term FROM wins),
post AS (SELECT terms.* FROM terms SEMI JOIN vocab USING (term)),
size AS (SELECT term, count(*) AS n_term FROM post GROUP BY term),
places AS (SELECT win, i - 1 AS place, win[i] AS term FROM wins, unnest(generate_series(1, n)) AS u(i)),
lens AS (SELECT DISTINCT n AS m FROM wins),
cuts AS (SELECT doc_id, i - 1 AS start, array_to_string(ws[i:i + m - 1], ' ') AS s FROM (SELECT * FROM d, lens), unnest(generate_series(1, len(ws) - m + 1)) AS u(i)),
hits AS (SELECT doc_id, start, n, items FROM cuts JOIN (SELECT *, array_to_string(win, ' ') AS s FROM wins) USING (s)),
covered AS (SELECT doc_id, count(DISTINCT start + k) AS n_hit FROM hits, unnest(generate_series(0, n - 1)) AS u(k) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM (SELECT doc_id, unnest(items) AS item FROM hits) GROUP BY doc_id),
ranked AS (SELECT win, term, place, row_number() OVER (PARTITION BY win ORDER BY n_term, place) AS k FROM places JOIN size USING (term)),
pairs AS (SELECT DISTINCT x.term AS t1, coalesce(y.term, x.term) AS t2, coalesce(y.place, x.place) - x.place AS apart FROM (SELECT * FROM ranked WHERE k = 1) x LEFT JOIN (SELECT * FROM ranked WHERE k = 2) y USING (win)),
near AS (SELECT p.doc_id, count(DISTINCT (t1, t2, apart, p.pos)) AS n_near FROM pairs JOIN post p ON p.term = t1 JOIN post s ON s.term = t2 AND s.doc_id = p.doc_id AND abs(s.pos - p.pos - apart) <= 3 GROUP BY p.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

COLLOCATIONS = r"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, (VALUES (1), (2), (3)) v(k))) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS MATERIALIZED (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM c, unnest(generate_series(1, k - 1)) AS u(j)),
s AS (SELECT cuts.*, fl.f AS l, fr.f AS r, CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rp),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS top FROM (SELECT lang, ws, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN longer ON longer.lang = least.lang AND longer.phrase = least.phrase AND k = 2 WHERE top IS NULL OR 100 * top < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

VARIANTS = r"""
WITH RECURSIVE steps AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
t AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
r AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, m, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)) AS b FROM r),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, t),
words AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(generate_series(1, length(word))) AS u(i)),
near AS MATERIALIZED (SELECT DISTINCT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
best AS (SELECT a, count(*) AS n_near, max(n) AS top, min_by(b, (-n, b)) AS b FROM near JOIN words ON words.word = b GROUP BY a),
f AS MATERIALIZED (SELECT words.word, CASE WHEN top >= 5 * n THEN b END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN top END AS form_n FROM words LEFT JOIN best ON best.a = words.word),
walk AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(root, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": WARC, "op4_quality": _quality(), "op6_jaccard_join": JACCARD, "op9_decontaminate": DECONTAMINATE, "op11_variants": VARIANTS, "op12_collocations": COLLOCATIONS}
