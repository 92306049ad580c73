"""Every registered query against its SQL on the smallest tables."""

import pytest

from proselens import queries

FEW = {"j22_common_words", "j22_common_expressions"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(name, agrees):
    assert agrees(queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_give_rows(name, spark, small):
    assert queries.QUERIES[name](spark, small).limit(1).count() == 1


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "rule", "hits", "density"]
    assert df.where("hits > 0").limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
