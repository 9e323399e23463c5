"""Document-topic relevance: mention features, tf-idf, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sections(passages: DataFrame) -> DataFrame:
    """Adds section_id: the number of headings up to each passage of its document."""
    own = W.partitionBy("document_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return passages.withColumn("section_id", F.sum(F.when(F.col("type") == "sectionHeading", 1).otherwise(0)).over(own))


def topic_shares(topics: DataFrame, passages: DataFrame) -> DataFrame:
    """(document_id, topic, n_passages, share): of a document's passages, those with the topic, whatever the case of its name
    and the blanks around it."""
    total = passages.groupBy("document_id").agg(F.count("*").alias("total"))
    found = topics.groupBy("document_id", F.lower(F.trim("topic")).alias("topic")).agg(F.count_distinct("idx").alias("n_passages"))
    return found.join(total, "document_id").select("document_id", "topic", "n_passages", F.try_divide("n_passages", "total").alias("share"))


def sizes(passages: DataFrame) -> DataFrame:
    """(document_id, kind, part, n): how many passages each page and each section of a document has."""
    part = F.explode(F.array(F.struct(F.lit("page").alias("kind"), F.col("page_number").cast("long").alias("part")), F.struct(F.lit("section").alias("kind"), F.col("section_id").cast("long").alias("part")))).alias("p")
    return sections(passages).select("document_id", part).groupBy("document_id", "p.kind", "p.part").agg(F.count("*").alias("n"))


def mention_features(topics: DataFrame, passages: DataFrame) -> DataFrame:
    """Per (document, topic): mentions, density, max_per_page, first_idx, earliness and decayed."""
    totals = passages.groupBy("document_id").agg(F.count("*").alias("total"), F.max("page_number").alias("max_page"))
    pages = topics.groupBy("document_id", "topic", "page_number").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.collect_list("idx").alias("at"))
    every = pages.groupBy("document_id", "topic").agg(F.sum("n").alias("mentions"), F.max("n").alias("max_per_page"), F.min("first_idx").alias("first_idx"), F.flatten(F.collect_list("at")).alias("at"))
    joined = every.join(totals, "document_id")
    decayed = F.aggregate("at", F.lit(0.0), lambda a, i: a + F.exp(-3.0 * i / F.col("total")))
    return joined.select("document_id", "topic", "mentions", "max_per_page", "first_idx", "total", F.try_divide("mentions", "total").alias("density"), (1 - F.col("first_idx") / F.col("total")).alias("earliness"), decayed.alias("decayed"))


def tf_idf(features: DataFrame, n_documents: DataFrame) -> DataFrame:
    """Adds df, idf = ln(N / (1 + df)) of at least 0, and tfidf = density * idf."""
    df = features.groupBy("topic").agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln(F.col("n_documents") / (1 + F.col("df"))), F.lit(0.0))
    # one row of totals
    return features.join(df, "topic").join(F.broadcast(n_documents)).withColumn("idf", idf).withColumn("tfidf", F.col("density") * F.col("idf")).drop("n_documents")


def threshold_class(feature: Column, low: float, high: float, larger: bool = True) -> Column:
    """Class 0, 1 or 2 of a feature; null is 0."""
    if larger:
        return F.when(feature >= high, 2).when(feature >= low, 1).otherwise(0)
    return F.when(feature <= low, 2).when(feature <= high, 1).otherwise(0)


def classification_report(predicted: DataFrame, classes: list[int]) -> DataFrame:
    """(class, precision, recall, f1, support) from columns score and predicted; a division by zero is 0."""
    sums = predicted.agg(*(e for c in classes for e in (F.count_if((F.col("score") == c) & (F.col("predicted") == c)).alias(f"tp{c}"), F.count_if(F.col("predicted") == c).alias(f"p{c}"), F.count_if(F.col("score") == c).alias(f"s{c}"))))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"p{c}").alias("p"), F.col(f"s{c}").alias("support")) for c in classes))).alias("x")).select("x.*")
    zero = F.lit(0.0)
    out = rows.withColumns({"precision": F.coalesce(F.try_divide("tp", "p"), zero), "recall": F.coalesce(F.try_divide("tp", "support"), zero)})
    return out.select("class", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero).alias("f1"), "support")
