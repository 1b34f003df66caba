from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return repr(round(value, 4))
    return str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Columns and all rows of a DataFrame equal those of a SQL text, in any order."""

    def check(df, sql: str) -> None:
        names = sorted(df.columns)
        got = sorted(tuple(_cell(row[n]) for n in names) for row in df.collect())
        cursor = duck.execute(sql)
        have = [d[0] for d in cursor.description]
        assert sorted(have) == names
        at = [have.index(n) for n in names]
        want = sorted(tuple(_cell(row[k]) for k in at) for row in cursor.fetchall())
        assert got == want

    return check
