import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    """Rows as comparable tuples, columns by name, doubles to 9 digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order)) for r in values)


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql):
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())

    return check
