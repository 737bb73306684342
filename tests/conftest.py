import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sql: str, d: str = SMALL):
        c = duckdb.connect()
        c.execute("set TimeZone = 'UTC'")
        for p in Path(d).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        got = c.execute(sql)
        return [x[0] for x in got.description], got.fetchall()

    return run


def plain(value):
    """A value in a form that compares across engines."""
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Check a query against its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, SMALL)
        columns, rows = duck(sql)
        assert sorted(df.columns) == sorted(columns)
        order = sorted(columns)
        mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
        theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)
        assert mine == theirs

    return check
