import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows as sorted tuples by column name, floats to nine places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(tuple(tidy(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def agrees(spark, duck, small):
    """Hold a query's rows against its SQL; returns the number of rows."""

    def check(query, sql):
        df = query(spark, small)
        got = rows_of(df.columns, df.collect())
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(list(rel.columns), rel.fetchall())
        return len(got)

    return check
