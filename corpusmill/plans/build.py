"""Registered queries for entity records, label rows, selection, comparison, nearness and whole builds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from corpusmill.operators import answers, detectors, documents, filters, labels, metrics, nearness, relevance, runs, scores, search, selection

from . import fixtures as fx
from .corpus import _EVAL, _POINTS, _counts, _swept
from .more import KEYS
from .registry import query


def _entities(spark, d):
    """Customers as concepts below their nations: every fifth has no aliases (an empty list), every seventh no label."""
    k = F.col("c_custkey")
    text = lambda v: F.struct(F.struct(F.lit("en").alias("language"), v.alias("value")).alias("en"))
    alias = F.to_json(F.struct(F.array(F.struct(F.lit("en").alias("language"), F.concat(F.lit("alias "), k).alias("value")), F.struct(F.lit("fr").alias("language"), F.lit("autre").alias("value"))).alias("en")))
    claim = lambda p, kind: F.struct(F.struct(F.lit(p).alias("property"), F.lit(kind).alias("snaktype"), F.struct(F.concat(F.lit("not "), k).alias("value")).alias("datavalue")).alias("mainsnak"))
    claims = F.to_json(F.struct(F.array(claim("P9", "value"), claim("P9", "novalue")).alias("P9"), F.array(claim("P1", "value")).alias("P1")))
    labels_ = F.to_json(F.when(k % 7 != 0, text(F.col("c_name"))).otherwise(text(F.lit(None).cast("string"))))
    body = F.concat(F.lit('{"labels":'), labels_, F.lit(',"aliases":'), F.when(k % 5 == 0, "[]").otherwise(alias), F.lit(',"descriptions":'), F.to_json(text(F.col("c_mktsegment"))), F.lit(',"claims":'), F.when(k % 3 == 0, "[]").otherwise(claims), F.lit("}"))
    return fx.table(spark, d, "customer").select(F.concat(F.lit("C"), k).alias("id"), body.alias("json"))


_ENTITIES = "ent AS (SELECT 'C' || c_custkey AS id, c_custkey AS k, c_name AS preferred_label, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['alias ' || c_custkey] END AS alternatives, c_mktsegment AS description, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['not ' || c_custkey] END AS negatives FROM customer WHERE c_custkey % 7 <> 0)"


@query("p18_entities", f"WITH {_ENTITIES} SELECT id, preferred_label, array_to_string(alternatives, ',') AS alternatives, description, array_to_string(negatives, ',') AS negatives FROM ent")
def p18(spark, d):
    return labels.concepts(_entities(spark, d)).select("id", "preferred_label", F.array_join("alternative_labels", ",").alias("alternatives"), "description", F.array_join("negative_labels", ",").alias("negatives"))


def _below(spark, d):
    """Every concept descends from the one of a tenth of its number."""
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").where("c_custkey >= 10").select(F.concat(F.lit("C"), F.floor(k / 10)).alias("id"), F.concat(F.lit("C"), k).alias("sub_id"))


@query("a28_subconcepts", f"WITH {_ENTITIES}, n AS (SELECT k // 10 AS up, unnest(list_concat([preferred_label], alternatives)) AS name FROM ent WHERE k >= 10), s AS (SELECT up, string_agg(DISTINCT name, ',' ORDER BY name) AS subs FROM n GROUP BY 1) SELECT id, coalesce(subs, '') AS subconcepts, CASE WHEN subs IS NOT NULL AND k % 2 = 0 THEN '' ELSE array_to_string(negatives, ',') END AS negatives FROM ent LEFT JOIN s ON s.up = k")
def a28(spark, d):
    """The negative label of concepts with an even number is made a name of one of those below them."""
    rows, below = labels.concepts(_entities(spark, d)), _below(spark, d)
    one = below.join(rows.select(F.col("id").alias("sub_id"), F.col("preferred_label").alias("_name")), "sub_id").groupBy("id").agg(F.min("_name").alias("_name"))
    k = F.substring("id", 2, 20).cast("long")
    rows = rows.join(one, "id", "left").withColumn("negative_labels", F.when(F.col("_name").isNotNull() & (k % 2 == 0) & (F.size("negative_labels") > 0), F.array("_name")).otherwise(F.col("negative_labels"))).drop("_name")
    return labels.with_subconcepts(rows, below).select("id", F.array_join("subconcept_labels", ",").alias("subconcepts"), F.array_join("negative_labels", ",").alias("negatives"))


@query("p16_document_labels", fx.with_sql("labels") + """SELECT DISTINCT id, type, value, '{"id":"' || id || '","type":"' || type || '","value":"' || value || '"}' AS label_source FROM doc_labels""")
def p16(spark, d):
    return labels.of_documents(fx.documents(spark, d)).select("id", "type", "value", "label_source")


@query("p17_concept_labels", f"WITH {_ENTITIES} SELECT 'concept::' || id AS id, preferred_label AS value, len(alternatives) AS n_alternatives, description, CASE WHEN k >= 10 THEN 'subconcept_of concept::C' || (k // 10) END AS parent FROM ent")
def p17(spark, d):
    named = lambda c: F.concat(F.lit("concept::"), c)
    up = _below(spark, d).select(named(F.col("sub_id")).alias("id"), F.lit("subconcept_of").alias("relationship"), named(F.col("id")).alias("parent_id"), F.lit("concept").alias("parent_type"), F.col("id").alias("parent_value"))
    rows = labels.of_concepts(labels.concepts(_entities(spark, d)), up)
    parent = F.get("labels", F.lit(0))
    return rows.select("id", "value", F.size("alternative_labels").cast("long").alias("n_alternatives"), "description", F.concat_ws(" ", parent["relationship"], parent["id"]).alias("parent")).withColumn("parent", F.nullif("parent", F.lit("")))


@query("d03_contents_listings", "SELECT doc_id, n >= 5 AND (doc_id % 3 = 0 OR doc_id % 3 = 1 AND n = 5) AS listing FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)")
def d03(spark, d):
    """Every document as a page of entries with climbing page numbers, falling ones, or none."""
    rows = fx.table(spark, d, "documents").where("text IS NOT NULL").withColumn("n", F.size(F.split("text", "\n")))
    page = lambda i: F.when(F.col("doc_id") % 3 == 0, F.floor(i / 5) + 1).otherwise(F.floor((F.col("n") - 1 - i) / 5) + 1)
    line = lambda i: F.concat(F.lit("What is said of "), i, F.lit("th matter "), F.when(F.col("doc_id") % 3 == 2, "and more;").otherwise(F.concat(F.lit(".... "), page(i))))
    listed = rows.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), line), "\n").alias("content"), F.lit(None).cast("int").alias("page_number"))
    return detectors.contents_listings(listed).select("doc_id", F.col("looks_like_table_of_contents").alias("listing"))


PAIRS = [(1, 0, "thble", "thing"), (2, 0, "erble", "attion"), (2, 1, "attion", "thing")]
_PAIRS = "pr(query_id, pair, a, b) AS (VALUES " + ", ".join(f"({q}, {p}, '{a}', '{b}')" for q, p, a, b in PAIRS) + ")"


@query(
    "r02_proximity",
    f"""WITH {_PAIRS}, en AS (SELECT query_id, pair, a AS term, 0 AS role FROM pr UNION ALL SELECT query_id, pair, b, 1 FROM pr),
    tk AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS t FROM documents)),
    pl AS (SELECT query_id, pair, doc_id, role, pos - last_value(CASE WHEN role = 0 THEN pos END IGNORE NULLS) OVER w AS ahead, pos - last_value(CASE WHEN role = 1 THEN pos END IGNORE NULLS) OVER w AS back FROM tk JOIN en USING (term) WINDOW w AS (PARTITION BY query_id, pair, doc_id ORDER BY pos, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT query_id, pair, doc_id, min(CASE WHEN role = 1 THEN ahead END) AS f, min(CASE WHEN role = 0 THEN back END) AS b FROM pl GROUP BY ALL),
    n AS (SELECT query_id, doc_id, sum(greatest(coalesce(1 - (f - 1) / 10.0, 0), 0.5 * coalesce(1 - (b - 1) / 10.0, 0), 0)) AS s FROM g GROUP BY ALL)
    SELECT query_id, doc_id, CAST(round(1 + 2 * s / (SELECT count(*) FROM pr WHERE pr.query_id = n.query_id), 6) AS DOUBLE) AS boost FROM n""",
)
def r02(spark, d):
    asked = spark.createDataFrame(PAIRS, "query_id int, pair int, first string, second string")
    near = nearness.proximity(fx.table(spark, d, "documents"), ["doc_id"], "text", asked)
    return near.select("query_id", "doc_id", F.round(scores.proximity_boost(F.col("proximity")), 6).alias("boost"))


_HAVE = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda x: x <> ''))"


@query(
    "r06_document_score",
    f"""WITH t AS (SELECT doc_id, source, {_HAVE.format("string_split(text, chr(10))[1]")} AS a, {_HAVE.format('text')} AS p FROM documents WHERE text IS NOT NULL),
    c AS (SELECT *, len(list_intersect(a, ['thing', 'erble', 'thble'])) AS na, len(list_intersect(p, ['thing', 'erble', 'thble'])) AS np FROM t)
    SELECT doc_id, round(3 * na / 3.0 + coalesce(na / nullif(len(a), 0), 0), 6) AS title_score, round(np / 3.0, 6) AS passages_score, round(3 * na / 3.0 + coalesce(na / nullif(len(a), 0), 0) + np / 3.0 + CASE WHEN source = 'src7' THEN 10000 ELSE 0 END, 6) AS score FROM c""",
)
def r06(spark, d):
    asked = F.array(*map(F.lit, ("thing", "erble", "thble")))
    whole, title = search.completeness(F.split("text", "\n")[0], asked)
    _, body = search.completeness(F.col("text"), asked)
    ranks = {"title": title, "passages": body, "identifiers": F.coalesce(F.col("source") == "src7", F.lit(False)).cast("int")}
    parts = scores.document_score(ranks, F.lit(0.0), F.coalesce(whole, F.lit(0.0)), F.lit(0.0))
    return fx.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *(F.round(parts[c], 6).alias(c) for c in ("title_score", "passages_score", "score")))


@query(
    "t11_hybrid",
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label AS l FROM embeddings WHERE vec_id IN (0, 1)),
    x AS (SELECT query_id, vec_id, round(acos(greatest(least(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 1), -1)), 3) AS distance, label = l AS matched FROM embeddings, q)
    SELECT query_id, vec_id, distance <= 1.2 AS near, matched FROM x WHERE matched OR distance <= 1.2""",
)
def t11(spark, d):
    e = fx.table(spark, d, "embeddings")
    asked = e.where("vec_id in (0, 1)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("_l"))
    rough = lambda a, b: F.round(nearness.angle(a, b), 3)
    return nearness.hybrid(e, "vec_id", "embedding", F.col("label") == F.col("_l"), asked, rough, 1.2, 1 << 30).select("query_id", "vec_id", "near", "matched")


@query(
    "m10_top_clicks_dwell",
    fx.with_sql("web_events")
    + """, v AS (SELECT distinct_id, ts, event_id, url, lead(url, 1) OVER w AS u1, lead(ts, 1) OVER w AS t1, lead(ts, 2) OVER w AS t2 FROM web_events WHERE event = '$pageview' AND consent IS NOT NULL WINDOW w AS (PARTITION BY distinct_id ORDER BY ts, event_id)),
    p AS (SELECT *, floor(epoch(coalesce(t1, TIMESTAMP '2024-03-01'))) - floor(epoch(ts)) >= 30 OR coalesce(u1 LIKE '/documents/%', false) AND floor(epoch(coalesce(t2, TIMESTAMP '2024-03-01'))) - floor(epoch(t1)) >= 30 AS stays FROM v WHERE url LIKE '/document/%'),
    c AS (SELECT e.event_id, e.distinct_id, arg_min(stays, (p.ts, p.event_id)) AS stays FROM web_events e JOIN p ON p.distinct_id = e.distinct_id AND p.ts > e.ts WHERE e.event = '$autocapture' AND e.url LIKE '/search%' AND e.k % 10 <= 5 GROUP BY ALL),
    u AS (SELECT DISTINCT distinct_id FROM v WHERE url LIKE '/search%')
    SELECT 'top_5_click_through_dwell_30' AS metric, round(100.0 * CAST(count(*) FILTER (WHERE distinct_id IN (SELECT distinct_id FROM c WHERE stays)) AS DOUBLE) / nullif(count(*), 0), 6) AS value FROM u""",
)
def m10(spark, d):
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    return metrics.top_click_through_dwell(fx.web_events(spark, d).withColumn("position", F.col("k") % 10), now)


@query("m11_periods", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS date_from, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS date_to, CAST(f - INTERVAL 1 DAY * CASE isodow(f) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS DATE) AS retention_date FROM (SELECT o_orderdate, date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS f FROM orders)")
def m11(spark, d):
    days = fx.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", *(c.alias(k) for k, c in metrics.periods(F.col("day")).items()))


@query("w07_metric_table", fx.with_sql("web_events") + ", n AS (SELECT round(100.0 * CAST(count(DISTINCT CASE WHEN url LIKE '/search%' THEN distinct_id END) AS DOUBLE) / nullif(count(DISTINCT distinct_id), 0), 6) AS v FROM web_events WHERE event = '$pageview' AND consent IS NOT NULL) SELECT 'searchers' AS metric, v AS value, DATE '2024-01-01' AS date_from, DATE '2024-01-31' AS date_to, 'ok' AS status FROM n UNION ALL SELECT 'too_young', NULL, DATE '2024-01-01', DATE '2024-01-31', 'ValueError'")
def w07(spark, d):
    events = fx.web_events(spark, d)

    def too_young():
        metrics.old_enough(date(2024, 1, 1), 30, date(2024, 1, 15))
        return metrics.retention(events, 30)

    return runs.metric_table(spark, {"searchers": lambda: metrics.users_who_search(events), "too_young": too_young}, date(2024, 1, 1), date(2024, 1, 31))


_FIGURES = f"WITH {_EVAL}, {_POINTS}, f AS (SELECT low || '-' || high AS predictor, (" + " + ".join(f"coalesce(2.0 * count(*) FILTER (WHERE score = {c} AND predicted = {c}) / nullif(count(*) FILTER (WHERE predicted = {c}) + count(*) FILTER (WHERE score = {c}), 0), 0)" for c in (1, 2)) + ") / 2 AS mean_f1, coalesce(2.0 * count(*) FILTER (WHERE score > 0 AND predicted > 0) / nullif(count(*) FILTER (WHERE predicted > 0) + count(*) FILTER (WHERE score > 0), 0), 0) AS binary_f1 FROM s GROUP BY 1)"


@query("a22_leaderboard", _FIGURES + " SELECT predictor, round(mean_f1, 6) AS mean_f1, round(binary_f1, 6) AS binary_f1, CAST(row_number() OVER (ORDER BY round(mean_f1, 9) DESC, predictor) AS INTEGER) AS place FROM f")
def a22(spark, d):
    rows = _swept(spark, d).withColumn("predictor", F.concat_ws("-", "low", "high"))
    board = runs.leaderboard(runs.figures(rows), ["mean_f1", "binary_f1"], "mean_f1")
    return board.withColumns({c: F.round(c, 6) for c in ("mean_f1", "binary_f1")})


@query("a26_disagreements", f"WITH {_EVAL}, p AS (SELECT lang, score, CASE WHEN size >= 2 THEN 2 WHEN size >= 0.5 THEN 1 ELSE 0 END AS a, CASE WHEN size >= 3 THEN 2 WHEN size >= 1 THEN 1 ELSE 0 END AS b FROM x) SELECT lang, count(*) AS n, count(*) FILTER (WHERE a <> b) AS n_disagree, count(*) FILTER (WHERE a = score) AS n_a_right, count(*) FILTER (WHERE b = score) AS n_b_right FROM p GROUP BY 1")
def a26(spark, d):
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    size = F.col("n_chars") / 1000
    rows = docs.select("lang", (F.col("quality") + F.col("toxic")).alias("score"), relevance.threshold_class(size, 0.5, 2.0).alias("a"), relevance.threshold_class(size, 1.0, 3.0).alias("b"))
    return runs.disagreements(runs.compared(rows, "a", "b", "score"), "lang")


@query("q08_suite", "SELECT e.engine, doc_id AS case_id, lang AS category, source AS terms, doc_id % 4 <> 0 AND doc_id % e.k = 0 AS passed, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 9 ELSE 0 END AS n_results FROM documents, (VALUES ('one', 2), ('two', 3)) e(engine, k)")
def q08(spark, d):
    cases = fx.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), F.col("source").alias("terms"))
    engines = spark.createDataFrame([("one", 2), ("two", 3)], "engine string, k int")
    done = cases.where("case_id % 4 <> 0").select("case_id", F.explode(F.array(F.struct(F.lit("one").alias("engine"), F.lit(2).alias("k")), F.struct(F.lit("two").alias("engine"), F.lit(3).alias("k")))).alias("x"))
    outcomes = done.select("x.engine", "case_id", (F.col("case_id") % F.col("x.k") == 0).alias("passed"), (F.col("case_id") % 9).alias("n_results"))
    return runs.suite(engines.select("engine"), cases, outcomes)


_TIERS = (
    fx.with_sql("passages", "passage_topics")
    + """, st AS (SELECT document_id, count(*) AS total, max(page_number) AS max_page FROM passages GROUP BY 1),
    tp AS (SELECT document_id, topic, n, n / total AS share FROM (SELECT document_id, topic, count(*) AS n FROM passage_topics GROUP BY ALL) JOIN st USING (document_id)),
    pk AS (SELECT *, percent_rank() OVER (PARTITION BY topic ORDER BY n) AS pa, percent_rank() OVER (PARTITION BY topic ORDER BY share) AS pr, document_id * 7919 % 10007 AS draw FROM tp),
    t1 AS (SELECT document_id, 'tier1_absolute:' || topic AS reason FROM pk WHERE pa >= 0.9 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY draw, document_id) = 1 UNION ALL SELECT document_id, 'tier1_relative:' || topic FROM pk WHERE pr >= 0.9 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY draw, document_id) = 1),
    me AS (SELECT doc_id AS document_id, source AS corpus, max_page, coalesce(lang, 'none') AS region, doc_id * 7919 % 10007 AS draw FROM documents JOIN st ON document_id = doc_id),
    t2 AS (SELECT document_id, 'tier2_corpus:' || corpus AS reason FROM me WHERE document_id NOT IN (SELECT document_id FROM t1) AND corpus IN ('src1', 'src2') QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY draw, document_id) <= CASE corpus WHEN 'src1' THEN 1 ELSE 2 END),
    t3 AS (SELECT document_id, 'tier3_length:' || band AS reason FROM (SELECT *, CASE WHEN max_page > 20 THEN 'long' WHEN max_page BETWEEN 2 AND 6 THEN 'medium' WHEN max_page < 1 THEN 'short' END AS band FROM me) WHERE band IS NOT NULL AND document_id NOT IN (SELECT document_id FROM t1 UNION ALL SELECT document_id FROM t2) QUALIFY row_number() OVER (PARTITION BY band ORDER BY draw, document_id) <= 2),
    ch AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
    hv AS (SELECT region, count(*) AS n FROM me WHERE document_id IN (SELECT document_id FROM ch) GROUP BY 1),
    on1 AS (SELECT document_id, region FROM me WHERE document_id NOT IN (SELECT document_id FROM ch) QUALIFY row_number() OVER (PARTITION BY region ORDER BY draw, document_id) = 1),
    t4 AS (SELECT document_id, 'tier4_geography:' || region AS reason FROM on1 LEFT JOIN hv USING (region) ORDER BY coalesce(n, 0), region LIMIT 2),
    al AS (SELECT * FROM ch UNION ALL SELECT * FROM t4)
    SELECT document_id, string_agg(reason, ' | ' ORDER BY reason) AS reasons, any_value(corpus) AS corpus, any_value(max_page) AS max_page FROM al JOIN me USING (document_id) GROUP BY 1"""
)


@query("e12_selection", _TIERS)
def e12(spark, d):
    passages = fx.passages(spark, d)
    stats = passages.groupBy("document_id").agg(F.count("*").alias("total"), F.max("page_number").alias("max_page"))
    topics = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n")).join(stats, "document_id").select("document_id", "topic", "n", (F.col("n") / F.col("total")).alias("share"))
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("corpus"), F.coalesce("lang", F.lit("none")).alias("region")).join(stats, "document_id")
    meta = docs.select("document_id", "corpus", "max_page")
    band = F.when(F.col("max_page") > 20, "long").when(F.col("max_page").between(2, 6), "medium").when(F.col("max_page") < 1, "short")
    draw = F.col("document_id") * 7919 % 10007
    chosen = selection.stratified(topics, meta, docs.select("document_id", "region"), {"src1": 1, "src2": 2}, band, draw, gaps=2)
    return selection.described(chosen, meta)


@query("n03_percent_ranks_share", fx.with_sql("passages", "passage_topics") + ", st AS (SELECT document_id, count(*) AS total FROM passages GROUP BY 1), tp AS (SELECT document_id, topic, n / total AS share FROM (SELECT document_id, topic, count(*) AS n FROM passage_topics GROUP BY ALL) JOIN st USING (document_id)) SELECT document_id, topic, round(percent_rank() OVER (PARTITION BY topic ORDER BY share), 6) AS rank FROM tp")
def n03_share(spark, d):
    total = fx.passages(spark, d).groupBy("document_id").agg(F.count("*").alias("total"))
    rows = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n")).join(total, "document_id").withColumn("share", F.col("n") / F.col("total"))
    return selection.percent_ranks(rows, "topic", "share", "rank").select("document_id", "topic", F.round("rank", 6).alias("rank"))


def _index(spark, d):
    docs = fx.documents(spark, d)
    lines = F.split("text", "\n")
    edges = F.when(F.col("doc_id") % 5 != 0, F.array(F.struct(F.lit("member_of").alias("type"), (F.col("doc_id") - F.col("doc_id") % 5).alias("value"))))
    return docs.withColumns({"id": F.col("doc_id"), "title": lines[0], "description": F.coalesce(F.get(lines, F.lit(1)), F.lit("")), "edges": F.coalesce(edges, F.array().cast("array<struct<type:string,value:bigint>>"))})


@query("p01_index_rows", "SELECT doc_id AS id, length(string_split(text, chr(10))[1]) AS n_title, length(nullif(string_split(text, chr(10))[2], '')) AS n_description, source AS provider, doc_id - doc_id % 5 AS principal_id, CASE WHEN doc_id % 7 <> 0 THEN 1704067200 + doc_id * 3600 END AS published FROM documents")
def p01(spark, d):
    rows = documents.index_rows(_index(spark, d), "provider")
    return rows.select("id", F.length("title").cast("long").alias("n_title"), F.length("description").cast("long").alias("n_description"), F.get("geographies", F.lit(0)).alias("provider"), "principal_id", "published")


@query("p21_whole_updates", fx.with_sql("passages") + "SELECT 'id:documents:documents::' || doc_id AS put, coalesce(n, 0) AS n, coalesce(source, 'MISSING') AS about FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM passages WHERE page_number > 0 GROUP BY 1) p ON p.document_id = doc_id")
def p21(spark, d):
    docs = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("description"), "labels")
    rows = documents.whole_updates(docs, fx.passages(spark, d).where("page_number > 0").select(*KEYS, "page_number", "content"))
    return rows.select("put", F.size("fields.passages").cast("long").alias("n"), F.get_json_object("fields.source", "$.description").alias("about"))


@query("p22_client_passages", fx.with_sql("passages") + "SELECT document_id, idx AS text_block_id, length(content) AS n_text, type, page_number AS first_page, 'concept::' || type AS label FROM passages")
def p22(spark, d):
    label = F.array(F.struct(F.concat(F.lit("concept::"), "type").alias("id"), F.lit("concept").alias("type"), F.col("type").alias("value"), F.lit("c1").alias("classifier_id")))
    rows = fx.passages(spark, d).select("document_id", F.col("idx").alias("id"), "content", F.col("type").alias("content_type"), F.array(F.struct(F.col("page_number").alias("number"))).alias("pages"), label.alias("labels"))
    out = documents.client_passages(rows)
    return out.select("document_id", "text_block_id", F.length("text").cast("long").alias("n_text"), "type", F.col("pages")[0].alias("first_page"), F.col("labels")[0]["value"]["id"].alias("label"))


_BUNDLE = fx.with_sql("labels") + ", h AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'en'), l AS (SELECT * FROM doc_labels WHERE doc_id IN (SELECT doc_id FROM h))"


@query("x06_bundle", _BUNDLE + " SELECT 'hits' AS part, CAST(doc_id AS VARCHAR) AS key, (SELECT count(*) FROM h) AS n FROM (SELECT doc_id FROM h ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL SELECT 'aggregations', type || '::' || value, count(DISTINCT doc_id) FROM l GROUP BY ALL UNION ALL SELECT 'facets_relationship', id, count(*) FROM l GROUP BY relationship, id")
def x06(spark, d):
    parts = answers.bundle(fx.documents(spark, d), filters.any_of(["language::en"]), [F.desc("n_chars"), "doc_id"], 10, by=("relationship",))
    rows = {"hits": (F.col("doc_id").cast("string"), "total"), "aggregations": (F.col("key"), "count"), "facets_relationship": (F.col("id"), "count")}
    out = [parts[p].select(F.lit(p).alias("part"), key.alias("key"), F.col(n).alias("n")) for p, (key, n) in rows.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def corpus(spark, d) -> dict:
    """The whole corpus: index rows of documents and passages, concept counts of documents and of principals, label rows."""
    lookup = _index(spark, d).select(F.col("id").alias("document_id"), documents.principal_id(F.col("id"), F.col("labels"), F.col("edges")).alias("principal_id")).where("principal_id is not null")
    counts = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n"))
    return {
        "documents": documents.index_rows(_index(spark, d), "provider"),
        "passages": documents.passage_rows(fx.passages(spark, d), lookup, _counts(spark, d, KEYS)),
        "concepts": counts,
        "principal_concepts": counts.join(lookup, "document_id").groupBy("principal_id", "topic").agg(F.sum("n").alias("n")),
        "labels": labels.of_documents(fx.documents(spark, d)).unionByName(labels.of_concepts(labels.concepts(_entities(spark, d)))),
    }


@query("x07_corpus_build", fx.with_sql("labels", "passages", "passage_topics") + ", c AS (SELECT DISTINCT document_id, topic FROM passage_topics) SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'passages', count(*) FROM passages UNION ALL SELECT 'concepts', count(*) FROM c UNION ALL SELECT 'principal_concepts', count(*) FROM (SELECT DISTINCT document_id - document_id % 5, topic FROM c) UNION ALL SELECT 'labels', (SELECT count(DISTINCT (id, type, value)) FROM doc_labels) + (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0)")
def x07(spark, d):
    sizes = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in corpus(spark, d).items()]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out
