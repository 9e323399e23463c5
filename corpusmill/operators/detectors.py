"""Passage-type detectors as Column expressions, and their evaluation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and limits of a reference list. Fixed values.
MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
CALENDAR_DATE = rf"\b(?:{MONTH})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}|\b\d{{1,2}}\s+(?:{MONTH})[a-z]*\.?,?\s+\d{{4}}"
WORD = "[A-Za-z][A-Za-z'-]*"
AUTHOR_INITIAL = r"(?<![.\d])\b[A-Z]\.(?!\d)"
CITATION_YEAR = r"\(\s*(?:n\.d\.|\d{4}[a-z]?)\s*\)\s*[.,:]|,\s*\d{4}[a-z]?\s*[.:]|\.\s\d{4}[a-z]?\."
SOURCE_LOCATOR = r"(?i)doi:|doi\.org|https?://|ftp://|(?<![/.])\bwww\.|Retrieved|Available (?:at|from|online)|Accessed|last visited|In press|ISSN|ISBN"
CONTACT_DETAIL = r"(?iu)@|Tel[.:]|Telephone|Teléfono|Fax|E-?mail|Correo"
FUNCTION_WORD = r"(?i)\b(?:the|of|and|to|in|that|which|for|with|as|by|is|are|was|will|be|been|this|these|has|have|from|on|at|it|its|not|but|their|our)\b"
LEAST_WORDS, MOST_FUNCTION, LEAST_CONTACT, LEAST_SIGNAL, LEAST_PERIODS, SIGNALS = 20, 25.0, 1.0, 2.0, 18.0, 2


def reference_list(content: Column) -> Column:
    """Long enough, no prose, no contact block, and at least two signs of citations, each by its share of the words."""
    text = F.regexp_replace(content, f"(?U){CALENDAR_DATE}", " ")
    n = F.regexp_count(text, F.lit(WORD))
    share = lambda pattern: 100 * F.try_divide(F.regexp_count(text, F.lit(f"(?U){pattern}")), n)
    periods = 100 * F.try_divide(F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))), n)
    signals = [share(p) >= LEAST_SIGNAL for p in (AUTHOR_INITIAL, CITATION_YEAR, SOURCE_LOCATOR)] + [periods >= LEAST_PERIODS]
    few = (share(FUNCTION_WORD) <= MOST_FUNCTION) & (share(CONTACT_DETAIL) < LEAST_CONTACT)
    return F.coalesce((n >= LEAST_WORDS) & few & (reduce(add, (s.cast("int") for s in signals)) >= SIGNALS), F.lit(False))


#: Patterns and limits of a contents listing. Fixed values.
LOCATOR_LINE = r"^[\s.·\-–—]*(\d{1,3}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8})[\s.·]*$"
SECTION_LINE = r"^\(?\d{1,2}(?:\.[1-9]\d?){2,}\.?\)?$"
DATA_CELL = r"(?i)^(?:[\d\s.,;:%()\[\]<>≤≥=+\-–—/*'\"$€£¥&]+|(?:NE|NO|NA|N/A|IE|NC|C|X|nil|na|-|—|–|\.)\.?)$"
TRAILING_LOCATOR = r"^(.*?[A-Za-z\)]\.?[\s.·]+)(\d{1,3}|[ivxlcdm]{2,8}|[IVXLCDM]{1,8})\.?$"
HIERARCHICAL = r"^\(?\d{1,2}(?:\.[1-9]\d?)+\.?\)?(?:\s+[A-Za-z(]|$)"
FLAT_NUMBER = r"(?i)^(?:\d{1,2}[.)]?|[IVXLCDM]{1,5}[.)]|[A-Za-z][.)]|\((?:[a-z]|[ivx]{1,4}|\d{1,2})\))\s+\S|^(?:chapter|annex|annexe|appendix|appendices|section|part|volume)\s+[\dIVXLCA-Z]"
FRONT_MATTER = r"(?im)table of contents|^\s*contents\b|list of (?:tables|figures|acronyms|abbreviations|annexes|appendices|boxes)|table of authorities"
ENTRY_WORD = r"(?i)\b(?:foreword|preface|acknowledge?ments?|executive summary|introduction|conclusions?|references|bibliography|glossary|annexe?|appendix|abbreviations|acronyms|chapter|section|summary|overview|background)\b"
PROSE, SENTENCE_END, CLAUSE_END = r"[.?;:]\s+[a-z]", r"[.;:,]$", r"[;,:]$"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
LEAST_LINES, LEAST_ENTRIES, LAST_PAGE, TITLE_WORDS, SENTENCE_WORDS = 4, 5, 10, 25, 15
SHARES = {"titles": 0.75, "sentences": 0.30, "data": 0.25, "clauses": 0.20, "equations": 0.20, "hierarchical": 0.35, "words": 0.25, "flat": 0.65, "pages": 0.40, "distinct": 0.80}


def folio(token: Column) -> Column:
    """A page number in figures or in Roman numerals; null for anything else."""
    digits = F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv))
    values = F.transform(F.split(F.reverse(F.lower(token)), ""), lambda c: F.try_element_at(digits, c))
    # read from the right, a numeral less than one before it is taken off
    step = lambda a, v: F.struct((a["n"] + F.when(v < a["most"], -v).otherwise(v)).alias("n"), F.greatest(a["most"], v).alias("most"))
    roman = F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(0).alias("most")), step)["n"]
    return F.when(token.rlike(r"^\d+$"), token.try_cast("int")).when(token.rlike("(?i)^[ivxlcdm]+$"), roman)


def contents_listings(passages: DataFrame, content: str = "content", page: str = "page_number") -> DataFrame:
    """Adds looks_like_table_of_contents: front matter of enough lines that look like titles, is neither table nor prose, and
    has at least one mark of a listing. A null page is no veto, a null text no listing. The lines are told apart once,
    then judged by their shares."""
    has = lambda pattern: lambda x: x.rlike(f"(?U){pattern}")
    number = lambda x: folio(F.regexp_extract(x, f"(?U){LOCATOR_LINE}", 1))
    kind = lambda x: F.when(has(SECTION_LINE)(x), "section").when(number(x) != 0, "folio").when(has(LOCATOR_LINE)(x) | has(DATA_CELL)(x), "data").otherwise("entry")
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    told = passages.withColumn("_l", F.transform(lines, lambda x: F.struct(x.alias("line"), kind(x).alias("kind"))))
    of = lambda k: F.filter("_l", lambda x: x["kind"] == k)
    told = told.withColumns({"_e": F.transform(of("entry"), lambda x: x["line"]), "_data": F.size(of("data")), "_sections": F.size(of("section"))})
    ends = F.transform("_e", lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, f"(?U){TRAILING_LOCATOR}", 1), "[ .·]+$", "").alias("title"), folio(F.regexp_extract(x, f"(?U){TRAILING_LOCATOR}", 2)).alias("page")))
    told = told.withColumn("_ends", F.filter(ends, lambda x: x["page"] != 0))
    n, n_words = F.size("_e"), lambda x: F.regexp_count(x, F.lit(r"(?U)\S+"))
    share = lambda test: F.try_divide(F.size(F.filter("_e", test)), n)
    pages, titles = F.transform("_ends", lambda x: x["page"]), F.array_distinct(F.transform("_ends", lambda x: x["title"]))
    enough = (F.size("_l") >= LEAST_LINES) & (n >= LEAST_ENTRIES) & (share(lambda x: (n_words(x) <= TITLE_WORDS) & ~has(PROSE)(x)) >= SHARES["titles"])
    vetoes = (F.try_divide("_data", F.size("_l")) > SHARES["data"]) | (share(lambda x: (n_words(x) > SENTENCE_WORDS) & has(SENTENCE_END)(x)) >= SHARES["sentences"]) | (share(has(CLAUSE_END)) >= SHARES["clauses"]) | (share(has("=")) >= SHARES["equations"])
    climbing = (F.try_divide(F.size("_ends"), n) >= SHARES["pages"]) & (F.try_divide(F.size(titles), F.size("_ends")) >= SHARES["distinct"]) & (pages == F.array_sort(pages))
    numbered = F.try_divide(F.size(F.filter("_e", has(HIERARCHICAL))) + F.col("_sections"), n) >= SHARES["hierarchical"]
    marks = F.col(content).rlike(f"(?U){FRONT_MATTER}") | numbered | (share(has(ENTRY_WORD)) >= SHARES["words"]) | (share(has(FLAT_NUMBER)) >= SHARES["flat"]) | climbing
    front = F.coalesce(F.col(page) <= LAST_PAGE, F.lit(True))
    return told.withColumn("looks_like_table_of_contents", F.coalesce(front & enough & ~vetoes & marks, F.lit(False))).drop("_l", "_e", "_data", "_sections", "_ends")


def evaluation(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """(slice, precision, recall, f1, false_positives, false_negatives) of columns label and predicted (booleans)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.coalesce(c, F.lit(False)).alias("inside")) for k, c in slices.items()))).alias("x")
    inside = rows.select("label", "predicted", each).where("x.inside")
    sums = inside.groupBy(F.col("x.slice").alias("slice")).agg(F.count_if(F.col("label") & F.col("predicted")).alias("tp"), F.count_if(~F.col("label") & F.col("predicted")).alias("false_positives"), F.count_if(F.col("label") & ~F.col("predicted")).alias("false_negatives"))
    zero, tp, fp, fn = F.lit(0.0), F.col("tp"), F.col("false_positives"), F.col("false_negatives")
    return sums.select("slice", F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"), "false_positives", "false_negatives")


def evaluated(rows: DataFrame, said: dict[str, Column], stratum: str = "stratum", label: str = "label") -> DataFrame:
    """(detector, slice, n, precision, recall, f1, false_positives, false_negatives) of detectors (Columns over ``rows``) over
    all rows and over each stratum, in one pass; a division by zero is 0."""
    slices = F.array_compact(F.array(F.lit("all rows"), F.concat(F.lit("stratum "), stratum)))
    each = [F.struct(F.lit(n).alias("detector"), F.coalesce(c, F.lit(False)).alias("said")) for n, c in said.items()]
    long = rows.select(F.col(label).alias("_is"), F.explode(slices).alias("slice"), F.array(*each).alias("_each")).select("_is", "slice", F.explode("_each").alias("x")).select("_is", "slice", "x.*")
    sums = long.groupBy("detector", "slice").agg(F.count("*").alias("n"), F.count_if(F.col("_is") & F.col("said")).alias("_tp"), F.count_if(F.col("said") & ~F.col("_is")).alias("false_positives"), F.count_if(F.col("_is") & ~F.col("said")).alias("false_negatives"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("_tp"), F.col("false_positives"), F.col("false_negatives")
    return sums.select("detector", "slice", "n", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "false_positives", "false_negatives")
