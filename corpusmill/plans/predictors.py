"""Registered queries for topic features and the registry of predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import analysis, derive, predictors, relevance, tuning

from . import fixtures as fx
from .corpus import _TOKENS, _swept
from .judging import _TREE, _edges
from .registry import ORACLE_SQL, query

_PLACES = fx.with_sql("passages", "passage_topics") + """, sec AS (SELECT *, CAST(sum(CASE WHEN type = 'sectionHeading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_id FROM passages),
    m AS (SELECT t.*, section_id FROM passage_topics t JOIN sec USING (document_id, idx)),
    tot AS (SELECT document_id, count(*) AS total, count(*) FILTER (WHERE page_number < 3) AS s3, count(*) FILTER (WHERE page_number < 5) AS s5, count(*) FILTER (WHERE page_number < 10) AS s10, count(*) FILTER (WHERE page_number < 15) AS s15 FROM passages GROUP BY 1),
    pg AS (SELECT document_id, topic, max(n) AS max_per_page FROM (SELECT document_id, topic, page_number, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL),
    sd AS (SELECT document_id, topic, max(k / size) AS max_section_density FROM (SELECT document_id, topic, section_id, count(DISTINCT idx) AS k FROM m GROUP BY ALL) JOIN (SELECT document_id, section_id, count(*) AS size FROM sec GROUP BY ALL) USING (document_id, section_id) GROUP BY ALL),
    st AS (SELECT topic, count(*) AS cf, count(DISTINCT document_id) AS df FROM m GROUP BY 1), n AS (SELECT count(*) AS np, count(DISTINCT document_id) AS nd FROM passages),
    ft AS (SELECT m.document_id, m.topic, count(*) AS mentions, count(*) / any_value(total) AS density, any_value(max_per_page) AS max_per_page, any_value(max_section_density) AS max_section_density, 1 - min(idx) / any_value(total) AS earliness, min(page_number) AS first_page,
      count(*) FILTER (WHERE idx < 0.15 * total) AS first_fraction, sum(exp(-3 * (idx / total))) AS decayed, count(*) FILTER (WHERE page_number < 3) AS first_3_pages, count(*) FILTER (WHERE page_number < 5) AS first_5_pages, count(*) FILTER (WHERE page_number < 10) AS first_10_pages, count(*) FILTER (WHERE page_number < 15) AS first_15_pages,
      count(DISTINCT CASE WHEN page_number < 3 THEN idx END) / any_value(s3) AS first_3_pages_density, count(DISTINCT CASE WHEN page_number < 5 THEN idx END) / any_value(s5) AS first_5_pages_density, count(DISTINCT CASE WHEN page_number < 10 THEN idx END) / any_value(s10) AS first_10_pages_density, count(DISTINCT CASE WHEN page_number < 15 THEN idx END) / any_value(s15) AS first_15_pages_density,
      count(*) * greatest(ln(any_value(nd) / (1 + any_value(df))), 0) AS count_df, count(*) * greatest(ln(any_value(np) / (1 + any_value(cf))), 0) AS count_cf, count(*) / any_value(total) * greatest(ln(any_value(nd) / (1 + any_value(df))), 0) AS density_df, count(*) / any_value(total) * greatest(ln(any_value(np) / (1 + any_value(cf))), 0) AS density_cf,
      (1 + ln(count(*))) * greatest(ln(any_value(nd) / (1 + any_value(df))), 0) AS lognorm_df, (1 + ln(count(*))) * greatest(ln(any_value(np) / (1 + any_value(cf))), 0) AS lognorm_cf
      FROM m JOIN tot USING (document_id) JOIN pg ON pg.document_id = m.document_id AND pg.topic = m.topic JOIN sd ON sd.document_id = m.document_id AND sd.topic = m.topic JOIN st ON st.topic = m.topic, n GROUP BY ALL)"""
_FLOATS = ["density", "max_section_density", "earliness", "decayed", *(f"first_{n}_pages_density" for n in (3, 5, 10, 15)), *(f"{a}_{b}" for a in ("count", "density", "lognorm") for b in ("df", "cf"))]
_COUNTS = ["mentions", "max_per_page", "first_page", "first_fraction", "first_3_pages", "first_5_pages", "first_10_pages", "first_15_pages"]


def _features(spark, d):
    sections = relevance.sections(fx.passages(spark, d)).select("document_id", "idx", "page_number", "section_id")
    places = fx.passage_topics(spark, d).join(sections.select("document_id", "idx", "section_id"), ["document_id", "idx"])
    return predictors.features(places, sections, predictors.corpus_stats(places, sections))


@query("e02_all_features", _PLACES + "SELECT document_id, topic, " + ", ".join([*(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS), *(f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in _FLOATS)]) + " FROM ft")
def e02_all(spark, d):
    return _features(spark, d).select("document_id", "topic", *(F.col(c).cast("long").alias(c) for c in _COUNTS), *(F.round(c, 6).alias(c) for c in _FLOATS))


def _over(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} >= {high!r} THEN 2 WHEN {x} >= {low!r} THEN 1 ELSE 0 END"


_PAGE = "CASE WHEN first_page <= 2 THEN 2 WHEN first_page <= 43.2 THEN 1 ELSE 0 END"
_CNT, _DEN = _over("mentions", 3.7, 308.6), _over("density", 0.0018735644118713008, 0.044774726260994414)
_PREDICTED = {
    "any-mention-is-relevant": ("CASE WHEN mentions > 0 THEN 2 ELSE 0 END", None), "mention-count": (_CNT, "mentions"), "mention-density": (_DEN, "density"), "max-mentions-per-page": (_over("max_per_page", 2, 11.2), "max_per_page"),
    "max-section-density": (_over("max_section_density", 0.09090909090909091, 1.0), "max_section_density"), "earliest-mention": (_over("earliness", 0.38225324027916247, 0.9854126501582999), "earliness"), "earliest-mention-page": (_PAGE, "-first_page"),
    "first-fraction": (_over("first_fraction", 1.5, 16), "first_fraction"), "decay-weighted": (_over("decayed", 1.984270124628002, 97.3581273356797), "decayed"), **{f"first-{n}-pages": (_over(f"first_{n}_pages", 0, high), f"first_{n}_pages") for n, high in ((3, 1), (5, 3), (10, 7), (15, 11))},
    "first-10-pages-density": (_over("first_10_pages_density", 0, 0.01563994722084777), "first_10_pages_density"), "(count or density) and early": (f"least(greatest({_CNT}, {_DEN}), {_PAGE})", None), "density and early": (f"least({_DEN}, {_PAGE})", None),
    "tfidf-density-df": (_over("density_df", 0.0017, 0.03091), "density_df"), "tfidf-density-cf": (_over("density_cf", 0.00969, 0.09477), "density_cf"), "tfidf-count-df": (_over("count_df", 3.809, 73.6), "count_df"), "tfidf-count-cf": (_over("count_cf", 20.73, 404.2), "count_cf"),
    "tfidf-lognorm-df": (_over("lognorm_df", 0.2851, 3.514), "lognorm_df"),
}


def _dcg(by: str, value: str, name: str) -> str:
    return f"(SELECT {by}, sum(g * s / n) AS {name}, sum(n) AS items FROM (SELECT {by}, g, n, (SELECT sum(1 / log2(b + i + 1)) FROM unnest(generate_series(1, n)) AS u(i)) AS s FROM (SELECT {by}, sum(score) AS g, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(count(*)) OVER (PARTITION BY {by} ORDER BY {value} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM v GROUP BY {by}, {value})) GROUP BY {by})"


def _ndcg(by: str) -> str:
    return f"SELECT {by}, got / best AS ndcg FROM {_dcg(by, 'value', 'got')} JOIN {_dcg(by, 'score', 'best')} t USING ({by}) WHERE best > 0 AND t.items >= 2"


_METRICS = ["precision", "recall", "f1", "f1_relevant", "precision_1", "recall_1", "precision_2", "recall_2", "precision_binary", "recall_binary", "f1_binary", "ndcg_by_document", "ndcg_pooled", "ndcg_by_topic"]


def _board() -> str:
    rows = " UNION ALL ".join(f"SELECT document_id, topic, score, {i} AS number, '{name}' AS predictor, {said} AS predicted, CAST({value or said} AS DOUBLE) AS raw FROM ex" for i, (name, (said, value)) in enumerate(_PREDICTED.items()))
    tests = {"0": ("score = 0", "predicted = 0"), "1": ("score = 1", "predicted = 1"), "2": ("score = 2", "predicted = 2"), "b": ("score > 0", "predicted > 0")}
    sums = ", ".join(f"count(*) FILTER (WHERE {a} AND {b}) AS tp{k}, count(*) FILTER (WHERE {b}) AS p{k}, count(*) FILTER (WHERE {a}) AS s{k}" for k, (a, b) in tests.items())
    ratio = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
    P, R, Q = ({k: ratio(*x) for k, x in ((k, (f"tp{k}", f"p{k}") if w == "P" else (f"tp{k}", f"s{k}") if w == "R" else (f"2.0 * tp{k}", f"(p{k} + s{k})")) for k in tests)} for w in "PRF")
    mean = lambda m, of: "(" + " + ".join(m[k] for k in of) + f") / {len(of)}"
    return f"""{_PLACES}, ex AS (SELECT l.doc_id AS document_id, t.topic, CAST((n_chars + t.i) % 3 AS INTEGER) AS score, ft.* EXCLUDE (document_id, topic) FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (VALUES ('Q1', 1), ('Q2', 2), ('Q3', 3), ('Q4', 4)) t(topic, i) LEFT JOIN ft ON ft.document_id = l.doc_id AND ft.topic = t.topic),
    st2 AS MATERIALIZED ({rows}), v AS MATERIALIZED (SELECT *, round(coalesce(raw, min(raw) OVER (PARTITION BY predictor) - 1, 0), 9) AS value FROM st2),
    c AS (SELECT predictor, any_value(number) AS number, count(*) AS support, {sums} FROM v GROUP BY 1),
    nd AS (SELECT predictor, avg(ndcg) AS ndcg_by_document, count(*) AS n_documents FROM ({_ndcg('predictor, document_id')}) GROUP BY 1), nt AS (SELECT predictor, avg(ndcg) AS ndcg_by_topic, count(*) AS n_topics FROM ({_ndcg('predictor, topic')}) GROUP BY 1), np2 AS ({_ndcg('predictor')}),
    w AS (SELECT predictor, number, {mean(P, '012')} AS precision, {mean(R, '012')} AS recall, {mean(Q, '012')} AS f1, {mean(Q, '12')} AS f1_relevant, {P['1']} AS precision_1, {R['1']} AS recall_1, {P['2']} AS precision_2, {R['2']} AS recall_2, {P['b']} AS precision_binary, {R['b']} AS recall_binary, {Q['b']} AS f1_binary, sb AS positives, support,
      coalesce(ndcg_by_document, 0) AS ndcg_by_document, coalesce(np2.ndcg, 0) AS ndcg_pooled, coalesce(ndcg_by_topic, 0) AS ndcg_by_topic, coalesce(n_documents, 0) AS n_documents, coalesce(n_topics, 0) AS n_topics FROM c LEFT JOIN nd USING (predictor) LEFT JOIN nt USING (predictor) LEFT JOIN np2 USING (predictor))
    SELECT predictor, {', '.join(f'CAST(round({m}, 6) AS DOUBLE) AS {m}' for m in _METRICS)}, positives, support, n_documents, n_topics, {', '.join(f'CAST(row_number() OVER (ORDER BY round({m}, 9) DESC, number) AS INTEGER) AS {p}' for m, p in (('f1_relevant', 'place_f1'), ('f1_binary', 'place_binary'), ('ndcg_by_document', 'place_ndcg')))} FROM w"""


def _examples(spark, d):
    topic = F.explode(F.array(*(F.struct(F.lit(f"Q{i}").alias("topic"), F.lit(i).alias("i")) for i in range(1, 5)))).alias("t")
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    pairs = fx.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), topic).join(docs, "document_id")
    return pairs.select("document_id", "t.topic", ((F.col("n_chars") + F.col("t.i")) % 3).cast("int").alias("score"))


@query("a22_registry_leaderboard", _board())
def a22_registry(spark, d):
    """All predictors of the registry over the labelled documents: reports, three rankings and three places."""
    rows = predictors.stacked(_examples(spark, d), _features(spark, d)).withColumn("value", F.round("value", 9))
    out = predictors.leaderboard(rows)
    return out.select("predictor", *(F.round(m, 6).alias(m) for m in _METRICS), "positives", F.col("support").cast("long").alias("support"), "n_documents", "n_topics", "place_f1", "place_binary", "place_ndcg")


@query("e10_over_folds", f"SELECT round(avg(held_out), 4) AS mean, round(stddev_pop(held_out), 4) AS deviation, count(*) AS folds FROM ({ORACLE_SQL['e10_cross_validation']})")
def e10_over_folds(spark, d):
    out = tuning.over_folds(tuning.cross_validated(_swept(spark, d), F.col("doc_id") % 5, 5))
    return out.select(F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "folds")


@query("j18_known_parents", _TREE + "SELECT DISTINCT child AS descendant, parent AS ancestor FROM e WHERE parent IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j18_known(spark, d):
    """Direct parents that are documents of a language, as concepts that exist."""
    return derive.direct_parents(derive.closure(_edges(spark, d)), fx.table(spark, d, "documents").where("lang = 'en'").select("doc_id"))


@query("t10_exact_passages", fx.with_sql("passages") + f"SELECT document_id, idx FROM (SELECT document_id, idx, ' ' || array_to_string({_TOKENS.format('')}, ' ') || ' ' AS t FROM passages) WHERE contains(t, ' of the ')")
def t10_exact(spark, d):
    return fx.passages(spark, d).where(analysis.exact_phrase(F.col("content"), "Of, the")).select("document_id", "idx")


@query("t10_label_matches", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS.format('').replace('content', 'd')} AS t FROM (SELECT doc_id, coalesce(source, '') || ' ' || coalesce(string_split(text, chr(10))[1], '') AS d FROM documents)) WHERE len(list_intersect(t, ['src3', 'inti'])) > 0")
def t10_labels(spark, d):
    """Documents as labels: the source as value, the first line as description."""
    docs = fx.table(spark, d, "documents")
    return docs.where(analysis.label_matches(F.col("source"), F.get(F.split("text", "\n"), 0), "INTI src3")).select("doc_id")
