"""Registered queries for fielded answers, query rewriting and filters of many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import analysis, fielded, filters, rewriting
from corpusmill.operators.fielded import Query

from . import fixtures as fx
from .corpus import _STOP, _TOKENS, _counts
from .registry import query

#: Rules of these tables' own words beside those of the documents.
OWN = {"erble": ["erble", '"thatin thatin"'], "thing": ["thtion", '"orre orre"']}
COUNTRIES = {"en": "United Kingdom", "de": "Germany", "fr": "France", "es": "Spain"}


def _has(i: str, op: str = "contains") -> dict:
    return {"field": "labels.value.id", "op": op, "value": i}


def _all(*parts: dict) -> dict:
    return {"op": "and", "filters": list(parts)}


QUERIES = [
    Query(1, "thble thing"),
    Query(2, "NZ Erble: thing", _all(_has("language::en"), _has("concept::Q1")), size=5, number=2),
    Query(3, "UK law attion", filters.any_of(["agent::src1", "agent::src2", "agent::src3"])),
    Query(4, " SRC-src7"),
    Query(5, None, _all(_has("concept::Q2"), _has("concept::Q4"), _has("language::en")), size=20),
    Query(6, "der nicht", order="title", descending=False),
    Query(7, "the and", _all(_has("quality::1"), {"field": "attributes_double", "key": "n_chars", "op": "gt", "value": 500}), "published", size=15),
    Query(8, "le la", _has("agent::src2", "not_contains"), "title"),
    Query(9, None, _has("language::de"), "published", descending=False, number=3),
]


def fielded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with fields: the first two lines as title and description, all of the text as passages, the country of the
    language, two identifiers, and the topics that their passages mention."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    country = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    docs = fx.documents(spark, d).withColumns({
        "title": F.get(lines, 0), "description": F.get(lines, 1), "passages": F.col("text"), "geographies": F.array_compact(F.array(F.try_element_at(country, F.col("lang")))),
        "identifiers": F.array_compact(F.array(F.concat(F.lit("SRC-"), "source"), F.concat(F.lit("P"), "doc_id"))),
    })
    counts = _counts(spark, d, ["document_id"]).withColumnRenamed("document_id", "doc_id")
    concept = lambda k: F.struct(F.concat(F.lit("concept::"), k).alias("id"), F.lit("concept").alias("type"), k.alias("value"), F.lit("concept").alias("relationship"))
    return docs.join(counts, "doc_id", "left").withColumn("concepts", F.transform(F.map_keys("counts"), concept))


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


#: What the queries above look for: (query, kind, item).
_ITEMS = [
    *((1, "items", x) for x in ("thble", "thtion", "orre orre")), *((1, k, x) for k in ("words", "names") for x in ("thble", "thing")),
    *((2, "items", x) for x in ("nz", "net zero", "erble", "thatin thatin", "thtion", "orre orre")), *((2, k, x) for k in ("words", "names") for x in ("nz", "erble", "thing")), (2, "names", "new zealand"),
    *((3, "items", x) for x in ("uk", "law", "act", "attion")), *((3, k, x) for k in ("words", "names") for x in ("uk", "law", "attion")), (3, "names", "united kingdom"),
    *((4, k, x) for k in ("items", "words", "names") for x in ("src", "src7")), (4, "whole", "src-src7"),
    *((6, k, x) for k in ("items", "words", "names") for x in ("der", "nicht")), *((7, k, x) for k in ("items", "words", "names") for x in ("the", "and")), *((8, k, x) for k in ("items", "words", "names") for x in ("le", "la")),
]
_NEXT = [(1, "thble", "thing"), (2, "nz", "erble"), (2, "erble", "thing"), (3, "uk", "law"), (3, "law", "attion"), (4, "src", "src7"), (6, "der", "nicht"), (7, "the", "and"), (8, "le", "la")]


def _tokens(column: str, profile: str) -> str:
    out = _TOKENS.format(f" AND x NOT IN {_STOP}" if profile == "passage" else "")
    if profile != "passage":
        out = out.replace("replace(replace(replace(content, '$', 'dollar'), '£', 'pound'), '€', 'euro')", "content")
    return out.replace("content", column)


def _sql(where: str) -> str:
    return (
        fx.with_sql("labels", "passages", "passage_topics").rstrip()
        + f""",
    c AS (SELECT document_id AS doc_id, topic, count(*) AS n FROM passage_topics GROUP BY ALL),
    lab AS (SELECT doc_id, id FROM doc_labels UNION ALL SELECT doc_id, 'concept::' || topic FROM c),
    d AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS passages, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(string_split(text, chr(10))[2], '') AS description,
      CASE lang WHEN 'en' THEN 'United Kingdom' WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'Spain' ELSE '' END AS geo, CASE WHEN doc_id % 7 <> 0 THEN 1704067200 + doc_id * 3600 END AS published FROM documents),
    tok AS (SELECT doc_id, 'title' AS field, {_tokens('title', 'title')} AS t FROM d UNION ALL SELECT doc_id, 'description', {_tokens('description', 'title')} FROM d
      UNION ALL SELECT doc_id, 'passages', {_tokens('passages', 'passage')} FROM d UNION ALL SELECT doc_id, 'geographies', {_tokens('geo', 'title')} FROM d),
    it(query_id, kind, item) AS {_values(_ITEMS)}, nx(query_id, a, b) AS {_values(_NEXT)},
    ps AS MATERIALIZED (SELECT * FROM (SELECT doc_id, field, t[i] AS term, i AS pos, len(t) AS size FROM tok, unnest(generate_series(1, len(t))) AS u(i) UNION ALL SELECT doc_id, field, t[i] || ' ' || t[i + 1], i, len(t) FROM tok, unnest(generate_series(1, len(t) - 1)) AS u(i)) WHERE term IN (SELECT item FROM it)),
    tf AS MATERIALIZED (SELECT doc_id, field, term, size, count(*) AS tf FROM ps GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT field, count(*) AS n, avg(len(t)) AS a FROM tok GROUP BY field),
    fi AS (SELECT query_id, field, part, item FROM it JOIN (VALUES ('items', 'title', 'title'), ('items', 'description', 'description'), ('items', 'passages', 'passages'), ('words', 'title', 'title_synonyms')) k(kind, field, part) USING (kind)),
    w AS (SELECT fi.*, a, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM fi JOIN st USING (field) LEFT JOIN df ON df.field = fi.field AND df.term = fi.item),
    whole AS (SELECT query_id, part, sum(idf) AS s FROM w GROUP BY ALL),
    r AS (SELECT query_id, part, doc_id, sum(idf * tf / (tf + 1.2 * (1 - 0.4 + 0.4 * size / a))) / any_value(s) AS rank FROM w JOIN tf ON tf.field = w.field AND tf.term = w.item JOIN whole USING (query_id, part) GROUP BY ALL),
    geo AS (SELECT DISTINCT query_id, doc_id FROM ps JOIN it ON kind = 'names' AND item = term WHERE field = 'geographies'),
    ids AS (SELECT DISTINCT query_id, doc_id FROM d JOIN it ON kind = 'whole' AND item IN (lower('SRC-' || source), 'p' || doc_id)),
    gap AS (SELECT nx.query_id, nx.a, nx.b, x.doc_id, min(CASE WHEN y.pos > x.pos THEN y.pos - x.pos END) AS f, min(CASE WHEN y.pos < x.pos THEN x.pos - y.pos END) AS g
      FROM nx JOIN ps x ON x.field = 'title' AND x.term = nx.a JOIN ps y ON y.field = 'title' AND y.term = nx.b AND y.doc_id = x.doc_id GROUP BY ALL),
    near AS (SELECT query_id, doc_id, sum(greatest(coalesce(greatest(1 - (f - 1) / 10, 0), 0), 0.5 * coalesce(greatest(1 - (g - 1) / 10, 0), 0))) / any_value(m) AS near FROM gap JOIN (SELECT query_id, count(*) AS m FROM nx GROUP BY 1) USING (query_id) GROUP BY ALL),
    comp AS (SELECT query_id, doc_id, count(DISTINCT term) / any_value(u) AS comp FROM ps JOIN it ON kind = 'words' AND item = term JOIN (SELECT doc_id, len(list_distinct(t)) AS u FROM tok WHERE field = 'title') USING (doc_id) WHERE field = 'title' GROUP BY ALL),
    hit AS (SELECT query_id, doc_id FROM r UNION SELECT query_id, doc_id FROM geo UNION SELECT query_id, doc_id FROM ids UNION SELECT q, doc_id FROM d, (VALUES (5), (9)) v(q)),
    ok AS ({where}),
    tp AS (SELECT v.q AS query_id, doc_id, sum(ln(1 + n)) AS topic FROM c JOIN (VALUES (2, 'Q1'), (5, 'Q2'), (5, 'Q4')) v(q, topic) USING (topic) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, 3 * coalesce(r1.rank, 0) + coalesce(near, 0) + coalesce(comp, 0) AS a, coalesce(r2.rank, 0) AS b, coalesce(r3.rank, 0) AS e, CASE WHEN geo.doc_id IS NULL THEN 0.0 ELSE 1 END AS f, coalesce(r4.rank, 0) AS g, CASE WHEN ids.doc_id IS NULL THEN 0.0 ELSE 10000 END AS h, coalesce(topic, 0) AS i
      FROM hit JOIN ok USING (query_id, doc_id) LEFT JOIN (FROM r WHERE part = 'title') r1 USING (query_id, doc_id) LEFT JOIN (FROM r WHERE part = 'description') r2 USING (query_id, doc_id) LEFT JOIN (FROM r WHERE part = 'passages') r3 USING (query_id, doc_id) LEFT JOIN (FROM r WHERE part = 'title_synonyms') r4 USING (query_id, doc_id)
      LEFT JOIN near USING (query_id, doc_id) LEFT JOIN comp USING (query_id, doc_id) LEFT JOIN geo USING (query_id, doc_id) LEFT JOIN ids USING (query_id, doc_id) LEFT JOIN tp USING (query_id, doc_id)),
    z AS (SELECT *, round(a + b + e + f + g + h + i, 6) AS score FROM s),
    o AS (SELECT z.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id IN (1, 2, 3, 4, 5) THEN -score WHEN query_id = 7 THEN -published WHEN query_id = 9 THEN published END NULLS LAST, CASE WHEN query_id = 6 AND title <> '' THEN lower(title) END NULLS LAST, CASE WHEN query_id = 8 AND title <> '' THEN lower(title) END DESC NULLS LAST, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_size FROM z JOIN d USING (doc_id))
    SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(rank AS INTEGER) AS rank, total_size, CAST(round(a, 6) AS DOUBLE) AS title_score, CAST(round(b, 6) AS DOUBLE) AS description_score, CAST(round(e, 6) AS DOUBLE) AS passages_score, CAST(f AS DOUBLE) AS geographies_score, CAST(round(g, 6) AS DOUBLE) AS title_synonyms_score, CAST(h AS DOUBLE) AS identifiers_score, CAST(round(i, 6) AS DOUBLE) AS topic_score, CAST(score AS DOUBLE) AS score
    FROM o WHERE rank > CASE query_id WHEN 2 THEN 5 WHEN 9 THEN 20 ELSE 0 END AND rank <= CASE query_id WHEN 5 THEN 20 WHEN 7 THEN 15 WHEN 9 THEN 30 ELSE 10 END"""
    )


_L = "EXISTS (SELECT 1 FROM lab x WHERE x.doc_id = d.doc_id AND x.id = '{}')"
_WHERE = [
    (1, "true"), (2, _L.format("language::en") + " AND " + _L.format("concept::Q1")), (3, "source IN ('src1', 'src2', 'src3')"), (4, "true"), (5, " AND ".join(_L.format(x) for x in ("concept::Q2", "concept::Q4", "language::en"))),
    (6, "true"), (7, _L.format("quality::1") + " AND n_chars > 500"), (8, "source IS DISTINCT FROM 'src2'"), (9, "lang = 'de'"),
]


def _allowed(conditions: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {q} AS query_id, doc_id FROM d WHERE {w}" for q, w in conditions)


@query("x01_fielded_answers", _sql(_allowed(_WHERE)))
def x01_fielded(spark, d):
    """Nine queries of unlike filters, orders and pages: rewritten, filtered, scored by field and topic, ranked and counted."""
    return fielded.answered(fielded_documents(spark, d), ["doc_id"], QUERIES, rewriting.rulebase("documents") | OWN, arrays=("labels", "concepts"))


@query("x02_fielded_principals", _sql(_allowed([(q, f"({w}) AND doc_id % 5 = 0") for q, w in _WHERE])))
def x02_fielded(spark, d):
    asked = [Query(**{**q.__dict__, "tree": filters.both(_has("status::Principal"), q.tree)}) for q in QUERIES]
    return fielded.answered(fielded_documents(spark, d), ["doc_id"], asked, rewriting.rulebase("documents") | OWN, arrays=("labels", "concepts"))


@query("f01_many_filters", fx.with_sql("labels", "passages", "passage_topics").rstrip() + f", c AS (SELECT DISTINCT document_id AS doc_id, topic FROM passage_topics), lab AS (SELECT doc_id, id FROM doc_labels UNION ALL SELECT doc_id, 'concept::' || topic FROM c), d AS (SELECT * FROM documents) SELECT query_id, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM ({_allowed(_WHERE)}) GROUP BY query_id")
def f01_many(spark, d):
    """How many documents pass the filter of each query, from one bitmap."""
    rows = fielded_documents(spark, d).select("doc_id", fielded.bitmaps(QUERIES, ("labels", "concepts")).alias("mask"))
    each = rows.select("doc_id", F.explode(F.filter(F.array(*(F.struct(F.lit(q.query_id).alias("query_id"), F.getbit(F.get("mask", F.lit(i // fielded.BITS)), F.lit(i % fielded.BITS)).alias("bit")) for i, q in enumerate(QUERIES))), lambda x: x["bit"] == 1)).alias("x"))
    return each.groupBy(F.col("x.query_id").alias("query_id")).agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


#: Words of the tables that stand for words of the rules, so that rules meet whole tables of queries.
ALIASES = {"thble": "nz", "thing": "law", "thtion": "ndc", "erble": "nature based solution", "attion": "tcfd", "nicht": "evs", "oning": "gga", "is": "phaseout"}


def _rules_sql(name: str) -> str:
    base = rewriting.rulebase(name)
    asked = "content"
    for a, b in ALIASES.items():
        asked = f"replace({asked}, '{a}', ' {b} ')"
    joined = f"array_to_string({_TOKENS.format('').replace('content', 'q')}, ' ')"
    case = "CASE s " + " ".join(f"WHEN '{left}' THEN '{'|'.join(right)}'" for left, right in base.items()) + " ELSE s END"
    count = "CASE s " + " ".join(f"WHEN '{left}' THEN {len(right)}" for left, right in base.items()) + " ELSE 1 END"
    longest = "nature based solution|" if "nature based solution" in base else ""
    return fx.with_sql("passages") + f", q AS (SELECT document_id, idx, {asked} AS q FROM passages WHERE type = 'sectionHeading'), p AS (SELECT document_id, idx, regexp_extract_all({joined} || ' ', '({longest}[^ ]+) ', 1) AS parts FROM q) SELECT document_id, idx, array_to_string(list_transform(parts, lambda s: {case}), ' / ') AS places, CAST(list_product(list_transform(list_prepend('', parts), lambda s: {count})) AS BIGINT) AS wordings FROM p"


def _rules(name: str):
    def run(spark, d):
        asked = F.col("content")
        for a, b in ALIASES.items():
            asked = F.replace(asked, F.lit(a), F.lit(f" {b} "))
        base = rewriting.rulebase(name)
        places = F.transform(rewriting.alternatives(asked, base), lambda p: F.array_join(p, "|"))
        wordings = F.aggregate(rewriting.alternatives(asked, base), F.lit(1).cast("long"), lambda n, p: n * F.size(p))
        return fx.passages(spark, d).where("type = 'sectionHeading'").select("document_id", "idx", F.array_join(places, " / ").alias("places"), wordings.alias("wordings"))

    return run


for _name in ("documents", "labels", "passages"):
    query(f"t06_rules_of_{_name}", _rules_sql(_name))(_rules(_name))


#: Queries over passages: by relevance with topics, and in reading order.
PASSAGES = [
    Query(1, "evs thble of", _all(_has("language::en"), _has("concept::Q1"))),
    Query(2, "ndc erble", size=25),
    Query(3, None, _all(_has("concept::Q2"), {"field": "labels.type", "op": "contains", "value": "concept"}), size=15, number=2),
    Query(4, "nicht thing", _has("agent::src1", "not_contains"), "idx", descending=False, size=30),
]
_PASSAGE_ITEMS = [*((1, x) for x in ("evs", "electric car", "electric vehicle", "thble")), *((2, x) for x in ("ndc", "nationally determined contribution", "erble")), *((4, x) for x in ("nicht", "thing"))]
_WITH_STOP = [(1, "of")]


def _passages_sql() -> str:
    has = "EXISTS (SELECT 1 FROM lab x WHERE x.document_id = p.document_id AND x.idx IN (-1, p.idx) AND x.id = '{}')"
    allowed = [(1, has.format("language::en") + " AND " + has.format("concept::Q1") + " AND false"), (2, "true"), (3, has.format("concept::Q2")), (4, "NOT " + has.format("agent::src1"))]
    heading = r"len(regexp_extract_all(content, '[^ \t-\r]+')) BETWEEN 1 AND 11 AND len(regexp_extract_all(content, '[A-Za-z]')) > 0 AND 10 * len(regexp_extract_all(content, '[A-Z]')) >= 9 * len(regexp_extract_all(content, '[A-Za-z]'))"
    return fx.with_sql("labels", "passages", "passage_topics").rstrip() + f""", lab AS (SELECT doc_id AS document_id, -1 AS idx, id FROM doc_labels UNION ALL SELECT DISTINCT document_id, idx, 'concept::' || topic FROM passage_topics),
    p AS (SELECT *, {heading} AS heading FROM passages), tok AS (SELECT document_id, idx, {_TOKENS.format(f' AND x NOT IN {_STOP}')} AS t FROM p), it(query_id, item) AS {_values([*_PASSAGE_ITEMS, *_WITH_STOP])},
    tf AS MATERIALIZED (SELECT document_id, idx, t[i] AS term, len(t) AS size, count(*) AS tf FROM tok, unnest(generate_series(1, len(t))) AS u(i) WHERE t[i] IN (SELECT item FROM it) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
    w AS (SELECT query_id, item, a, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM it LEFT JOIN df ON term = item, st), whole AS (SELECT query_id, sum(idf) AS s FROM w GROUP BY 1),
    r AS (SELECT query_id, document_id, idx, sum(idf * tf / (tf + 1.2 * (1 - 0.4 + 0.4 * size / a))) / any_value(s) AS rank FROM w JOIN tf ON term = item JOIN whole USING (query_id) GROUP BY ALL),
    hit AS (SELECT query_id, document_id, idx, rank FROM r UNION ALL SELECT 3, document_id, idx, 0 FROM p),
    ok AS ({' UNION ALL '.join(f'SELECT {q} AS query_id, document_id, idx FROM p WHERE {c}' for q, c in allowed)}),
    tp AS (SELECT 3 AS query_id, document_id, idx, 1 AS topic FROM passage_topics WHERE topic = 'Q2' GROUP BY ALL),
    z AS (SELECT hit.query_id, hit.document_id, hit.idx, rank, CASE WHEN heading THEN 0.15 ELSE 0 END AS pen, coalesce(topic, 0) AS topic FROM hit JOIN ok USING (query_id, document_id, idx) JOIN p USING (document_id, idx) LEFT JOIN tp USING (query_id, document_id, idx)),
    o AS (SELECT *, round(rank - pen + topic, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id = 4 THEN idx ELSE -round(rank - pen + topic, 6) END, document_id, idx) AS place, count(*) OVER (PARTITION BY query_id) AS total_size FROM z)
    SELECT CAST(query_id AS BIGINT) AS query_id, document_id, idx, CAST(place AS INTEGER) AS rank, total_size, CAST(round(rank, 6) AS DOUBLE) AS text_score, CAST(pen AS DOUBLE) AS penalty, CAST(topic AS DOUBLE) AS topic_score, CAST(score AS DOUBLE) AS score
    FROM o WHERE place > CASE query_id WHEN 3 THEN 15 ELSE 0 END AND place <= CASE query_id WHEN 1 THEN 10 WHEN 2 THEN 25 ELSE 30 END"""


@query("x03_fielded_passages", _passages_sql())
def x03_fielded(spark, d):
    """Passages with the detectors' own flags, filters in one element, topics that they carry, and reading order."""
    from corpusmill.operators import detectors, feeds

    rows = detectors.contents_listings(fx.passages(spark, d), "content", "page_number")
    rows = rows.withColumns({"heading": feeds.heading_by_content(F.col("content")), "listing": F.col("looks_like_table_of_contents"), "references": detectors.reference_list(F.col("content"))})
    labels = fx.documents(spark, d).select(F.col("doc_id").alias("document_id"), "labels")
    concept = lambda k: F.struct(F.concat(F.lit("concept::"), k).alias("id"), F.lit("concept").alias("type"), k.alias("value"), F.lit("concept").alias("relationship"))
    rows = rows.join(labels, "document_id").join(_counts(spark, d, ["document_id", "idx"]), ["document_id", "idx"], "left").withColumn("concepts", F.transform(F.map_keys("counts"), concept))
    return fielded.answered(rows, ["document_id", "idx"], PASSAGES, rewriting.rulebase("passages"), {}, {"content": "passage"}, ("labels", "concepts"), flags={"heading": "heading", "contents": "listing", "references": "references"})


@query("a07_flat_facets_with_concepts", fx.with_sql("labels", "passages", "passage_topics") + "SELECT key, count(DISTINCT doc_id) AS count FROM (SELECT doc_id, type || '::' || value AS key FROM doc_labels UNION ALL SELECT document_id, 'concept::' || topic FROM passage_topics) GROUP BY 1")
def a07_concepts(spark, d):
    from corpusmill.operators import facets

    return facets.flat(fielded_documents(spark, d), arrays=("labels", "concepts"))
