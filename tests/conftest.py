import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, small):
    """Asserts that a query's rows are those of its SQL, in any order."""

    def norm(v):
        return round(v, 9) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        ours = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        theirs = sorted(([norm(r[names.index(c)]) for c in cols] for r in found.fetchall()), key=repr)
        assert ours == theirs
        return len(ours)

    return check
