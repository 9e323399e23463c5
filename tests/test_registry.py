import duckdb
import pytest

from corpusmill.operators import filters
from corpusmill.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "labels", "nation", "region", "customer", "embeddings", "orders"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(None if v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(tuple(r[c] for c in names) for r in got.collect()) == plain(want.fetchall())


def test_exact_passages_equal_sql_beside_signs(spark, tmp_path):
    texts = ["Of$$$ the&&& a\nof*** the\nOf the$ a\n$of the", "of £ the\nOf,\u20ac the\nOF - the\nof\nthe", "İof the\nof the İ\nofİ the", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = c.execute(registry.ORACLE_SQL["t10_exact_passages"]).fetchall()
    assert plain(registry.QUERIES["t10_exact_passages"](spark, str(tmp_path)).collect()) == plain(want) == [(0, 1), (1, 2), (2, 1)]


def test_wrong_operation_raises():
    with pytest.raises(ValueError):
        filters.condition({"field": "attributes_string", "key": "a", "op": "gt", "value": "x"})


def test_pruning_collapses_groups():
    tree = {"op": "and", "filters": [{"op": "or", "filters": [{"field": "labels.value.id", "op": "contains", "value": "a::1"}]}]}
    assert filters.prune(tree, "a") is None
    assert filters.prune(tree, "b") == tree
    assert filters.groups(tree) == ["a"]
