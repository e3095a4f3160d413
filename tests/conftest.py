import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def rows(frame) -> list[tuple]:
    """Rows of a pandas frame with sorted columns, comparable across engines."""
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert list(map(repr, rows(got))) == list(map(repr, rows(want)))

    return check
