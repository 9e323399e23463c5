"""Line dedup by a tree of line templates.

A line falls into a leaf by its number of tokens and its leading tokens; tokens with digits are variable fields
from the start. Inside a leaf, each token is counted over the distinct lines that have it at its position; the rarest
tokens of a line, as many as a template may have variable fields, are variable fields, and tokens as frequent as the
rarest of the rest are constant. That compares a line's tokens with each other, so it does not depend on the size of
the leaf. Lines with the same constants share a template. A line recurs if another document has the same line (white
space aside, but with the same numbers), or if its template, mostly constant, is found in enough documents. Of a recurring line the document with the smallest doc_id keeps it; all others drop it.

Lines of few tokens are never dropped, nor are repetitions inside one document. Null texts stay null, texts without
lines to drop are unchanged. A null doc_id comes after all others: its lines go if they recur elsewhere. Rows that
repeat a doc_id are one document. Ties in a token's count are constant together. An empty table gives no rows;
further columns are kept, but for those that the result adds. A very long text is one array of lines in its row; its
lines are rows of their own from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, maybe_broadcast, tidy, written

#: Tokens that a line needs to be looked at, and to have a template with variable fields.
LEAST_TOKENS, LEAST_TEMPLATE = 4, 8
LEADING = 3
#: Documents that must have a template.
SUPPORT = 4
#: Hundredths of a template's tokens that are constant.
CONSTANT = 75


def normal(line: Column) -> Column:
    """Tokens joined by single spaces."""
    odd = line.rlike("[\\t-\\r]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(line, "[ \\t-\\r]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """A normal line with its tokens with digits as variable fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def tree_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line, tokens, leaf, sig1, sig2, mask) of the lines with enough tokens.

    sig1 and sig2 name the line itself, leaf and mask (or sig1 where mask is null: no token has digits) the line with
    its variable fields, which is ``line``. All of a line is worked out inside its document's array, so that later
    filters cannot repeat the work.
    """

    def place(raw: Column) -> Column:
        tokens = F.length(raw) - F.length(F.replace(raw, F.lit(" "), F.lit(""))) + 1

        def of(line: Column) -> Column:
            mask = F.when(line != raw, F.xxhash64(line))
            return F.struct(line.alias("line"), tokens.alias("tokens"), F.xxhash64(tokens, F.substring_index(line, " ", LEADING)).alias("leaf"), F.xxhash64(raw).alias("sig1"), F.xxhash64(F.lit(7), raw).alias("sig2"), mask.alias("mask"))

        return let(masked(raw), of)

    lines = F.transform(F.split("text", "\n"), lambda raw: let(normal(raw), place))
    # the text's hash is made before its lines are opened up; beside the explode it would be made for each of them. The
    # outer form keeps the lines from being made for a filter; the null of a text without lines has no tokens.
    parted = docs.select("doc_id", F.xxhash64("text").alias("row"), lines.alias("x"))
    return parted.select("doc_id", "row", F.posexplode_outer("x").alias("pos", "x")).select("doc_id", "row", "pos", "x.*").where(F.col("tokens") >= LEAST_TOKENS)


def templates(docs: DataFrame, lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(sig1, sig2, first_doc) of the lines whose template with variable fields recurs."""
    name = F.coalesce("mask", "sig1").alias("name")
    long = F.col("tokens") >= LEAST_TEMPLATE
    leaves = written(distinct.where(long).groupBy("leaf").agg(F.count("*").alias("_lines"), F.sum("rows").alias("_n")).where((F.col("_lines") > 1) & (F.col("_n") >= SUPPORT)).select("leaf"))
    hint = maybe_broadcast(leaves)
    few = tree_lines(docs).where(long).join(hint, "leaf", "left_semi").groupBy("leaf", name).agg(F.first("line").alias("line"), F.first("tokens").alias("tokens"))
    tokens = written(few.select("leaf", "name", "tokens", F.posexplode(F.split("line", " ")).alias("pos", "token")))
    common = tokens.groupBy("leaf", "pos", "token").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    counted = tokens.join(common, ["leaf", "pos", "token"], "left").withColumn("n", F.when(F.col("token") == "<*>", F.lit(0)).otherwise(F.coalesce("n", F.lit(1))))
    # only the counts are sorted, to find how frequent a constant is at least
    line = counted.groupBy("leaf", "name", "tokens").agg(F.collect_list(F.struct("n", F.xxhash64("pos", "token").alias("h"))).alias("t"))
    limit = F.get(F.sort_array(F.transform("t", lambda x: x["n"])), F.floor(F.col("tokens") * (100 - CONSTANT) / 100).cast("int"))
    constants = let(limit, lambda least: F.filter("t", lambda x: (x["n"] >= least) & (x["n"] > 0)))
    line = line.withColumn("c", constants).select("leaf", "name", "tokens", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["h"])).alias("template"), F.size("c").alias("constants"))
    line = written(line.where(100 * F.col("constants") >= CONSTANT * F.col("tokens")).select("leaf", "name", F.xxhash64("template", "constants").alias("template")))
    # templates of enough lines at all, then of enough documents, over all documents of each line
    known = distinct.where(long).select("leaf", name, "sig1", "sig2", "rows").join(line, ["leaf", "name"])
    some = known.groupBy("leaf", "template").agg(F.sum("rows").alias("_n")).where(F.col("_n") >= SUPPORT).select("leaf", "template")
    line = written(line.join(some, ["leaf", "template"]))
    found = lines.where(long).select("leaf", name, "doc_id").join(maybe_broadcast(line), ["leaf", "name"])
    shared = found.groupBy("leaf", "template").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("_docs")).where(F.col("_docs") >= SUPPORT)
    return distinct.where(long).select("leaf", name, "sig1", "sig2").join(line.join(shared, ["leaf", "template"]), ["leaf", "name"]).select("sig1", "sig2", "first_doc")


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted positions ``gone``: what lies between them, joined."""

    def parts(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
        spans = F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda a, k: F.slice(lines, a + 2, F.get(edges, k + 1) - a - 1))
        return F.array_join(F.flatten(spans), "\n")

    return let(F.split(text, "\n"), parts)


@tidy
def drop_recurring(docs: DataFrame) -> DataFrame:
    """The documents without recurring lines, with n_lines, n_dropped (long) and emptied (all lines went)."""
    lines = written(tree_lines(docs).drop("line"))
    distinct = written(lines.groupBy("sig1", "sig2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"), F.first("mask").alias("mask"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nameless")))
    same = distinct.where("first_doc < last_doc or nameless > 0 and first_doc is not null").select("sig1", "sig2", "first_doc")
    # written, so that both sides of the join are plain shuffles and a very common line can be split
    recurring = written(same.union(templates(docs, lines, distinct)).groupBy("sig1", "sig2").agg(F.min("first_doc").alias("first_doc")))
    gone = lines.join(recurring, ["sig1", "sig2"]).where("doc_id is null or doc_id > first_doc")
    gone = written(gone.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_set("pos")).alias("_gone")))
    keyed = docs.drop("n_lines", "n_dropped", "emptied").withColumn("_key", F.xxhash64("text"))
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_row")), "left").drop("_doc", "_row", "_key")
    n = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    both = both.withColumns({"n_lines": F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long"), "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(n).cast("long")})
    both = both.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("_gone")))).drop("_gone")
    return both.withColumn("emptied", (F.col("n_dropped") > 0) & ~F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False)))
