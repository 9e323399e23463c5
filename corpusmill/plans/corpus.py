"""Registered queries for corpus building, text analysis, combined scores, result tests and tuning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import analysis, documents, facets, filters, judging, metrics, relevance, scores, tuning

from . import fixtures as fx
from .more import _BM25, KEYS, _scored
from .registry import query

_P, _T = fx.with_sql("passages"), fx.with_sql("passages", "passage_topics")
_COUNTS = _T + ", c AS (SELECT document_id, topic, count(*) AS n FROM passage_topics GROUP BY ALL)"


def _counts(spark, d, keys):
    """Maps topic -> count."""
    each = fx.passage_topics(spark, d).groupBy(*keys, "topic").agg(F.count("*").cast("double").alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("counts"))


@query("p04_values_of_relationship", fx.with_sql("labels") + "SELECT doc_id, string_agg(value, ',' ORDER BY value) AS values_joined FROM doc_labels WHERE relationship = 'tagged' GROUP BY 1")
def p04(spark, d):
    got = fx.documents(spark, d).select("doc_id", F.array_join(F.sort_array(documents.values_of(F.col("labels"), "tagged")), ",").alias("values_joined"))
    return got.where("values_joined <> ''")


@query("p06_facet_keys", fx.with_sql("labels") + "SELECT doc_id, type || '::' || value AS flat, type || '::' || id || '::' || value AS by_type, relationship || '::' || id || '::' || value AS by_relationship FROM doc_labels")
def p06(spark, d):
    return fx.documents(spark, d).select("doc_id", F.explode(documents.facet_keys(F.col("labels"))).alias("k")).select("doc_id", "k.*")


@query("p08_document_passages", _P + "SELECT document_id, string_agg(page_number || ':' || length(content), ',' ORDER BY idx) AS pages FROM passages GROUP BY 1")
def p08(spark, d):
    entry = lambda x: F.concat(x["page_number"].cast("string"), F.lit(":"), F.length(x["content"]).cast("string"))
    return documents.blocks_of(fx.passages(spark, d)).select("document_id", F.array_join(F.transform("passages", entry), ",").alias("pages"))


@query("p09_passage_rows", _COUNTS + ", k AS (SELECT document_id, idx, count(*) AS concepts FROM passage_topics GROUP BY ALL) SELECT document_id, idx, nullif(page_number, 0) AS page_number, length(nullif(content, '')) AS n, document_id - document_id % 5 AS principal_id, concepts FROM passages LEFT JOIN k USING (document_id, idx)")
def p09(spark, d):
    lookup = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") - F.col("doc_id") % 5).alias("principal_id")).distinct()
    concepts = fx.passage_topics(spark, d).groupBy(*KEYS).agg(F.count("*").alias("concepts"))
    return documents.passage_rows(fx.passages(spark, d), lookup, concepts).select(*KEYS, "page_number", F.length("content").alias("n"), "principal_id", "concepts")


@query("p12_heading_text", _P + "SELECT document_id, idx, CASE WHEN idx % 3 = 0 THEN 'Heading ' || idx END AS heading FROM passages")
def p12(spark, d):
    heading = F.when(F.col("idx") % 3 == 0, F.concat(F.lit(" Heading "), "idx")).otherwise(F.lit(" "))
    text = F.concat(F.when(F.col("idx") % 3 == 2, "Text: ").otherwise("Section: '"), heading, F.lit("'. "), F.col("content"))
    return fx.passages(spark, d).select(*KEYS, documents.heading_from_serialised(text, F.col("content"), "Section: '").alias("heading"))


@query("p13_reference", "SELECT doc_id, 'id:doc::' || doc_id AS reference FROM documents")
def p13(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", documents.reference("id:doc::", F.col("doc_id")).alias("reference"))


@query("p19_merged_labels", fx.with_sql("labels") + ", u AS (SELECT doc_id, id FROM doc_labels UNION ALL SELECT doc_id, coalesce('concept::' || lang, 'MISSING') FROM documents) SELECT doc_id, string_agg(id, ',' ORDER BY id) AS ids FROM u GROUP BY 1")
def p19(spark, d):
    concept = F.array(F.struct(F.concat(F.lit("concept::"), "lang").alias("id"), F.lit("concept").alias("type"), F.col("lang").alias("value")))
    merged = documents.merged_labels(F.col("labels"), concept)
    return fx.documents(spark, d).select("doc_id", F.array_join(F.sort_array(F.transform(merged, lambda x: x["id"])), ",").alias("ids"))


@query("p23_all_names", "SELECT n_nationkey, n_name || ',' || lower(n_name) AS names FROM nation")
def p23(spark, d):
    names = documents.all_names(F.col("n_name"), F.array(F.lower("n_name")), F.lit(None).cast("array<string>"))
    return fx.table(spark, d, "nation").select("n_nationkey", F.array_join(names, ",").alias("names"))


@query("j03_heading_lookup", _P + "SELECT p.document_id, p.idx, length(h.content) AS n FROM passages p LEFT JOIN passages h ON h.document_id = p.document_id AND h.idx = CASE WHEN p.idx % 2 = 1 THEN p.idx - 1 END")
def j03_lookup(spark, d):
    rows = fx.passages(spark, d).withColumn("heading_id", F.when(F.col("idx") % 2 == 1, F.col("idx") - 1))
    return documents.heading_texts(rows).select(*KEYS, F.length("heading_text").alias("n"))


@query("a27_latest", "SELECT event_type, max(ts) AS ts FROM events GROUP BY 1")
def a27(spark, d):
    return documents.latest(fx.table(spark, d, "events"), "event_type", "ts")


@query("f10_corpus", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def f10(spark, d):
    return fx.documents(spark, d).where(filters.build(filters.any_of(["agent::src1", "agent::src2", "agent::src3"]))).select("doc_id")


@query("f12_all_topics", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0' AND doc_id % 5 = 0")
def f12(spark, d):
    tree = filters.both(filters.all_of(["language::en", "agent::src0"]), filters.any_of(["status::Principal"]))
    return fx.documents(spark, d).where(filters.build(tree)).select("doc_id")


@query("f13_label_prefix", "SELECT doc_id FROM documents WHERE starts_with(lower(text), 'th') OR starts_with('doc ' || source, 'doc src1')")
def f13(spark, d):
    """Documents named by their first word, with their source as another name."""
    docs = fx.table(spark, d, "documents")
    other = F.array(F.concat(F.lit("Doc "), "source"))
    return docs.where(filters.named(F.col("text"), other, "TH") | filters.named(F.col("text"), other, "doc SRC1")).select("doc_id")


_STOP = "(" + ", ".join(f"'{w}'" for w in analysis.STOPWORDS) + ")"
_TOKENS = r"list_filter(regexp_split_to_array(lower(replace(replace(replace(content, '$', 'dollar'), '£', 'pound'), '€', 'euro')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''{})"


@query("t01_passage_tokens", _P + f"SELECT document_id, idx, md5(array_to_string({_TOKENS.format(f' AND x NOT IN {_STOP}')}, ' ')) AS tokens FROM passages")
def t01(spark, d):
    return fx.passages(spark, d).select(*KEYS, F.md5(F.array_join(analysis.analyzed(F.col("content")), " ").cast("binary")).alias("tokens"))


@query("t02_tokens_and_stems", _P + f"SELECT document_id, idx, CAST(len(list_distinct(list_concat(t, list_transform(t, lambda x: CASE x WHEN 'thble' THEN 'thb' WHEN 'thing' THEN 'th' ELSE x END)))) AS INTEGER) AS n FROM (SELECT *, {_TOKENS.format('')} AS t FROM passages)")
def t02(spark, d):
    stems = F.create_map(F.lit("thble"), F.lit("thb"), F.lit("thing"), F.lit("th"))
    return fx.passages(spark, d).select(*KEYS, F.size(analysis.with_stems(analysis.words(analysis.currency_words(F.col("content"))), stems)).alias("n"))


@query("t05_synonyms", "SELECT n_nationkey, 'law of ' || n || ' | law of ' || s AS variants FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'uk' WHEN 1 THEN 'south korea' ELSE 'holland' END AS n, CASE n_nationkey % 3 WHEN 0 THEN 'united kingdom' WHEN 1 THEN 'korea republic of' ELSE 'netherlands' END AS s FROM nation)")
def t05(spark, d):
    name = F.when(F.col("n_nationkey") % 3 == 0, "UK").when(F.col("n_nationkey") % 3 == 1, "South Korea").otherwise("Holland")
    return fx.table(spark, d, "nation").select("n_nationkey", F.array_join(analysis.with_synonyms(F.concat(F.lit("Law of "), name)), " | ").alias("variants"))


@query("t06_rewrites", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'the ndc|the nationally determined contribution' WHEN 1 THEN 'nature based solution|nbs' ELSE 'electric evs|electric electric car|electric electric vehicle' END AS phrases FROM nation")
def t06(spark, d):
    asked = F.when(F.col("n_nationkey") % 3 == 0, "The NDC").when(F.col("n_nationkey") % 3 == 1, "nature-based solution").otherwise("electric EVs")
    return fx.table(spark, d, "nation").select("n_nationkey", F.array_join(analysis.rewritten(asked), "|").alias("phrases"))


@query("t07_any_phrase", _P + f"SELECT document_id, idx FROM (SELECT document_id, idx, ' ' || array_to_string({_TOKENS.format(f' AND x NOT IN {_STOP}')}, ' ') || ' ' AS t FROM passages) WHERE contains(t, ' thble ') OR contains(t, ' erble thing ')")
def t07(spark, d):
    return fx.passages(spark, d).where(analysis.any_phrase(F.col("content"), F.array(F.lit("thble"), F.lit("erble thing")))).select(*KEYS)


_FLAGGED = _BM25 + ", tc AS (SELECT document_id, idx, count(DISTINCT topic) AS topics FROM passage_topics WHERE topic IN ('Q1', 'Q4') GROUP BY ALL), fl AS (SELECT s.*, CASE WHEN type = 'sectionHeading' THEN 1 ELSE 0 END AS h, CASE WHEN page_number > 3 THEN 1 ELSE 0 END AS t, CASE WHEN page_number = 1 THEN 1 ELSE 0 END AS r, coalesce(topics, 0) AS topics FROM s JOIN passages USING (document_id, idx) LEFT JOIN tc USING (document_id, idx))"
_FLAGGED = _FLAGGED.replace(", tok AS", ", " + fx.SQL["passage_topics"] + ", tok AS", 1)


def _flagged(spark, d):
    rows = fx.passages(spark, d).select(*KEYS, (F.col("type") == "sectionHeading").alias("heading"), (F.col("page_number") > 3).alias("contents"), (F.col("page_number") == 1).alias("references"))
    return _scored(spark, d).join(rows, KEYS).join(_counts(spark, d, KEYS), KEYS, "left").withColumn("topic", scores.passage_topics(F.coalesce("counts", F.create_map().cast("map<string,double>")), ["Q1", "Q4"]))


def _flags():
    return {k: F.col(k) for k in scores.PENALTIES}


@query("r03_multiplicative", _FLAGGED + " SELECT query_id, document_id, idx, round((score + topics) * (1 - 0.15 * h) * (1 - 0.35 * t) * (1 - 0.5 * r), 4) AS score FROM fl")
def r03(spark, d):
    return _flagged(spark, d).select("query_id", *KEYS, F.round(scores.multiplicative(F.col("score"), F.col("topic"), _flags()), 4).alias("score"))


@query("r05_additive", _FLAGGED + " SELECT query_id, document_id, idx, score AS text_score, CAST(round(0.15 * h + 0.35 * t + 0.5 * r, 6) AS DOUBLE) AS penalty, CAST(topics AS DOUBLE) AS topic_score, round(score - (0.15 * h + 0.35 * t + 0.5 * r) + topics, 6) AS relevance FROM fl")
def r05(spark, d):
    """With every component beside the score."""
    return _flagged(spark, d).select("query_id", *KEYS, F.col("score").alias("text_score"), F.round(scores.penalty(_flags()), 6).alias("penalty"), F.col("topic").alias("topic_score"), F.round(scores.additive(F.col("score"), F.col("topic"), _flags()), 6).alias("relevance"))


@query("r07_document_topics", _COUNTS + " SELECT document_id, round(sum(CASE WHEN topic IN ('Q1', 'Q3') THEN 2 * ln(1 + n) ELSE 0 END), 6) AS score FROM c GROUP BY 1")
def r07(spark, d):
    tree = {"op": "and", "filters": [{"field": "labels.value.id", "op": "contains", "value": f"concept::{t}"} for t in ("Q1", "Q3", "Q1")]}
    topics = [t.removeprefix("concept::") for t in scores.topic_ids(tree)]
    return _counts(spark, d, ["document_id"]).select("document_id", F.round(scores.document_topics(F.col("counts"), topics, 2.0), 6).alias("score"))


@query("r08_label_boost", "SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END AS DOUBLE) AS boost FROM documents")
def r08(spark, d):
    return fx.documents(spark, d).select("doc_id", scores.label_boost(F.col("labels"), F.lit("language::en")).alias("boost"))


@query("r10_blended", _COUNTS + " SELECT document_id, CAST(round(5 * sum(CASE topic WHEN 'Q1' THEN 0.99 * n WHEN 'Q2' THEN 0.5 * n ELSE 0 END) + 2 * sum(CASE topic WHEN 'Q1' THEN 0.99 * n WHEN 'Q2' THEN 0.5 * n ELSE 0 END), 6) AS DOUBLE) AS score FROM c GROUP BY 1")
def r10(spark, d):
    return _counts(spark, d, ["document_id"]).select("document_id", F.round(scores.blended(F.col("counts"), F.col("counts"), {"Q1": 0.99, "Q2": 0.5}, 5.0, 2.0), 6).alias("score"))


@query("r09_label_score", "SELECT n_nationkey, round(3 * (1 + (n_nationkey % 3) / 3.0 + 0.5 / 3) + (1.5 * (n_nationkey % 2) + 0.25) * sqrt(n_regionkey / 4.0), 6) AS score FROM nation")
def r09(spark, d):
    score = scores.label_score(F.lit(1.0), F.col("n_nationkey") % 2, F.lit(0.25), F.col("n_nationkey") % 3, F.lit(0.5), F.col("n_regionkey") / 4)
    return fx.table(spark, d, "nation").select("n_nationkey", F.round(score, 6).alias("score"))


@query("a11_page_with_total", "SELECT doc_id, count(*) OVER () AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def a11(spark, d):
    tree = filters.any_of(["language::en"])
    return facets.page(fx.documents(spark, d), tree, [F.desc("n_chars"), "doc_id"], 10, 2).select("doc_id", "total")


@query("a17_ordered_strings", "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, arg_min(n_name, n_nationkey) AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a17(spark, d):
    both = fx.table(spark, d, "nation").join(F.broadcast(fx.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"), F.min_by("n_name", "n_nationkey").alias("first_nation"))


_EVAL = "x AS (SELECT d.doc_id, lang, quality + toxic AS score, n_chars / 1000.0 AS size FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
_GRID = [(a / 2, b / 2) for a in range(1, 6) for b in range(a, 8)]
_POINTS = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in _GRID) + ") v(low, high)), s AS (SELECT x.*, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CASE WHEN size >= high THEN 2 WHEN size >= low THEN 1 ELSE 0 END AS predicted FROM x, g)"
_F1 = "(coalesce(2.0 * {p}tp1 / nullif({p}p1 + {p}s1, 0), 0) + coalesce(2.0 * {p}tp2 / nullif({p}p2 + {p}s2, 0), 0)) / 2"
_SUMS = ", ".join(f"count(*) FILTER (WHERE score = {c} AND predicted = {c}) AS tp{c}, count(*) FILTER (WHERE predicted = {c}) AS p{c}, count(*) FILTER (WHERE score = {c}) AS s{c}" for c in (1, 2))


def _swept(spark, d):
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    return tuning.sweep(docs.select("doc_id", "lang", (F.col("quality") + F.col("toxic")).alias("score"), (F.col("n_chars") / 1000.0).alias("size")), "size", _GRID)


@query("e07_sweep", f"WITH {_EVAL}, {_POINTS} SELECT low, high, predicted, count(*) AS n FROM s GROUP BY ALL")
def e07(spark, d):
    return _swept(spark, d).groupBy("low", "high", "predicted").agg(F.count("*").alias("n"))


@query("e09_best_thresholds", f"WITH {_EVAL}, {_POINTS}, f AS (SELECT low, high, {_SUMS} FROM s GROUP BY ALL), h AS (SELECT low, high, {_F1.format(p='')} AS f1 FROM f) SELECT low, high, round(f1, 6) AS f1 FROM h ORDER BY round(f1, 9) DESC, low, high LIMIT 1")
def e09(spark, d):
    return tuning.best(tuning.grid_scores(_swept(spark, d))).select("low", "high", F.round("f1", 6).alias("f1"))


_REST = ", ".join(f"sum({k}{c}) OVER (PARTITION BY low, high) - {k}{c} AS r_{k}{c}" for c in (1, 2) for k in ("tp", "p", "s"))


@query(
    "e10_cross_validation",
    f"WITH {_EVAL}, {_POINTS}, f AS (SELECT doc_id % 5 AS fold, low, high, {_SUMS} FROM s GROUP BY ALL), o AS (SELECT *, {_REST} FROM f), h AS (SELECT fold, low, high, {_F1.format(p='r_')} AS train, {_F1.format(p='')} AS held_out FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(train, 9) DESC, low, high) AS i FROM h) SELECT fold, low, high, round(held_out, 6) AS held_out FROM k WHERE i = 1",
)
def e10(spark, d):
    return tuning.cross_validated(_swept(spark, d), F.col("doc_id") % 5, 5).select("fold", "low", "high", F.round("held_out", 6).alias("held_out"))


_PRED = _EVAL + ", y AS (SELECT *, CASE WHEN size >= 2 THEN 2 WHEN size >= 1 THEN 1 ELSE 0 END AS predicted FROM x), r AS (SELECT lang, c AS class, count(*) FILTER (WHERE score = c AND predicted = c) AS tp, count(*) FILTER (WHERE predicted = c) AS p, count(*) FILTER (WHERE score = c) AS support FROM y, (VALUES (0), (1), (2)) v(c) GROUP BY ALL)"


def _predicted(spark, d):
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    return docs.select("lang", (F.col("quality") + F.col("toxic")).alias("score"), relevance.threshold_class(F.col("n_chars") / 1000.0, 1.0, 2.0).alias("predicted"))


@query("a19_report_by_group", f"WITH {_PRED} SELECT lang, class, round(coalesce(2.0 * tp / nullif(p + support, 0), 0), 6) AS f1, support FROM r")
def a19_groups(spark, d):
    return tuning.report_by(_predicted(spark, d), ["lang"], [0, 1, 2]).withColumn("f1", F.round("f1", 6))


@query("a19_macro", f"WITH {_PRED} SELECT class, round(avg(coalesce(2.0 * tp / nullif(p + support, 0), 0)), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM r WHERE support > 0 GROUP BY 1")
def a19_macro(spark, d):
    return tuning.macro(tuning.report_by(_predicted(spark, d), ["lang"], [0, 1, 2])).withColumn("f1", F.round("f1", 6))


@query("a18_binary", f"WITH {_PRED}, b AS (SELECT count(*) FILTER (WHERE score > 0 AND predicted > 0) AS tp, count(*) FILTER (WHERE predicted > 0) AS p, count(*) FILTER (WHERE score > 0) AS s FROM y) SELECT round(tp / nullif(p, 0), 6) AS precision, round(tp / nullif(s, 0), 6) AS recall, round(2.0 * tp / nullif(p + s, 0), 6) AS f1 FROM b")
def a18_binary(spark, d):
    return tuning.binary(_predicted(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("n04_seeded_pick", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919 + 13) % 10007, doc_id) AS k FROM documents) WHERE k <= 2")
def n04(spark, d):
    own = W.partitionBy("source").orderBy((F.col("doc_id") * 7919 + 13) % 10007, "doc_id")
    return fx.table(spark, d, "documents").select("source", "doc_id", F.row_number().over(own).alias("k")).where("k <= 2").select("source", "doc_id")


@query("n05_rare_sources", "SELECT source, n, CAST(dense_rank() OVER (ORDER BY n) AS INTEGER) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def n05(spark, d):
    counts = fx.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    places = counts.select("n").distinct().withColumn("place", F.dense_rank().over(W.orderBy("n")))  # one row for each distinct count
    return counts.join(places, "n").select("source", "n", "place")


@query("n07_first_of_group", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN doc_id % 7 <> 0 THEN n_chars END NULLS LAST, doc_id) AS k FROM documents) WHERE k = 1")
def n07(spark, d):
    order = F.struct(F.expr("doc_id % 7 = 0").alias("missing"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n"), F.col("doc_id").alias("id"))
    return fx.table(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", order).alias("doc_id"))


@query("l03_reading_order", _P + "SELECT document_id, idx FROM (SELECT document_id, idx, CASE WHEN idx % 4 <> 3 THEN idx END AS place FROM passages) ORDER BY place NULLS LAST, document_id, idx LIMIT 30 OFFSET 500")
def l03(spark, d):
    place = F.when(F.col("idx") % 4 != 3, F.col("idx"))
    return fx.passages(spark, d).orderBy(place.asc_nulls_last(), "document_id", "idx").offset(500).limit(30).select(*KEYS)


@query("u01_tiers", "SELECT doc_id, 'long' AS tier FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, 'good' FROM labels WHERE quality = 1")
def u01(spark, d):
    long = fx.table(spark, d, "documents").where("n_chars > 5000").select("doc_id", F.lit("long").alias("tier"))
    return long.unionByName(fx.table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("good").alias("tier")))


_RESULTS = "res AS (SELECT CAST(substr(source, 4) AS INTEGER) AS case_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), l AS (SELECT case_id, list(id ORDER BY rank) AS ids FROM res WHERE rank <= 10 GROUP BY 1)"


def _results(spark, d):
    own = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    docs = fx.table(spark, d, "documents").where("source is not null")
    return docs.select(F.substring("source", 4, 9).cast("int").alias("case_id"), F.col("doc_id").alias("id"), F.row_number().over(own).alias("rank")).where("rank <= 10")


def _cases(spark, d):
    """One case a source: its two longest documents are expected, swapped for odd ones; a shorter one is forbidden."""
    lists = _results(spark, d).groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("l"))
    odd = F.col("case_id") % 2 == 1
    two = F.when(odd, F.array(F.get("l", F.lit(1)), F.get("l", F.lit(0)))).otherwise(F.slice("l", 1, 2))
    return lists.select("case_id", two.alias("expected"), F.slice("l", 4, 1).alias("forbidden"), (F.col("case_id") % 3 == 0).alias("strict"), (F.col("case_id") % 4 + 1).alias("k"), F.get("l", F.lit(1)).alias("higher"), F.get("l", F.lit(2)).alias("lower"))


@query("q01_precision", f"WITH {_RESULTS} SELECT case_id, case_id % 2 = 0 OR case_id % 3 <> 0 AS passed FROM l")
def q01(spark, d):
    return judging.precision(_cases(spark, d), _results(spark, d)).select("case_id", "passed")


@query("q02_recall", f"WITH {_RESULTS} SELECT case_id, case_id % 4 + 1 BETWEEN 2 AND 3 AS passed, CAST(greatest(2 - (case_id % 4 + 1), 0) AS INTEGER) AS n_missing FROM l")
def q02(spark, d):
    return judging.recall(_cases(spark, d), _results(spark, d)).select("case_id", "passed", F.size("missing").alias("n_missing"))


@query("q03_relative_order", f"WITH {_RESULTS} SELECT case_id, case_id % 4 + 1 >= 2 AS passed, 2 AS rank_higher, 3 AS rank_lower FROM l")
def q03(spark, d):
    return judging.relative_order(_cases(spark, d), _results(spark, d)).select("case_id", "passed", "rank_higher", "rank_lower")


@query("q04_characteristics", f"WITH {_RESULTS} SELECT case_id, bool_and(id % 2 = 0) AS passed FROM res WHERE rank <= case_id % 4 + 1 GROUP BY 1")
def q04(spark, d):
    return judging.characteristics(_cases(spark, d), _results(spark, d), F.col("id") % 2 == 0).select("case_id", "passed")


@query("q06_diagnosis", f"WITH {_RESULTS} SELECT case_id, ids[CASE WHEN case_id % 2 = 1 THEN 3 - e ELSE e END] AS id, CAST(e AS INTEGER) AS expected_rank, CAST(CASE WHEN case_id % 2 = 1 THEN 3 - e ELSE e END AS INTEGER) AS actual_rank FROM l, (VALUES (1), (2)) v(e)")
def q06(spark, d):
    return judging.diagnosis(_cases(spark, d), _results(spark, d)).select("case_id", "id", "expected_rank", "actual_rank")


@query("m09_top_clicks", fx.with_sql("web_events") + "SELECT 'top_5_click_through' AS metric, round(100.0 * CAST(count(DISTINCT CASE WHEN event = '$autocapture' AND k % 10 <= 5 THEN distinct_id END) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN url LIKE '/search%' THEN distinct_id END), 0), 6) AS value FROM web_events")
def m09(spark, d):
    return metrics.top_click_through(fx.web_events(spark, d).withColumn("position", F.col("k") % 10))


@query(
    "a29_latency_quantiles",
    fx.with_sql("web_events")
    + """, b AS (SELECT event AS w, le, count(*) FILTER (WHERE k <= le) AS c FROM web_events, (VALUES (10.0), (25.0), (50.0), (100.0)) v(le) GROUP BY ALL),
    s AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY w ORDER BY le), 0) AS below, coalesce(lag(c) OVER (PARTITION BY w ORDER BY le), 0) AS before, max(c) OVER (PARTITION BY w) AS a FROM b)
    SELECT w AS "window", round(min(CASE WHEN c >= 0.5 * a AND before < 0.5 * a THEN below + (le - below) * (0.5 * a - before) / nullif(c - before, 0) END), 6) AS q50, round(min(CASE WHEN c >= 0.95 * a AND before < 0.95 * a THEN below + (le - below) * (0.95 * a - before) / nullif(c - before, 0) END), 6) AS q95 FROM s GROUP BY 1""",
)
def a29(spark, d):
    bounds = F.explode(F.array(*(F.lit(x) for x in (10.0, 25.0, 50.0, 100.0)))).alias("le")
    counts = fx.web_events(spark, d).select(F.col("event").alias("window"), "k", bounds).groupBy("window", "le").agg(F.count_if(F.col("k") <= F.col("le")).alias("count"))
    return metrics.latency_quantiles(counts, [0.5, 0.95]).select("window", F.round("q50", 6).alias("q50"), F.round("q95", 6).alias("q95"))
