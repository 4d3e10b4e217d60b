import sys
from pathlib import Path

import pytest
from hypothesis import settings

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
settings.register_profile("any_speed", deadline=None)
settings.load_profile("any_speed")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same_rows(df, duck, sql: str) -> None:
    """A Spark result and a DuckDB one have the same columns and rows, in any order."""
    mine, done = df.toArrow(), duck.execute(sql)
    columns = [d[0] for d in done.description]
    assert sorted(mine.column_names) == sorted(columns)
    names = sorted(columns)
    got = sorted(tuple(map(repr, r)) for r in zip(*[mine.column(n).to_pylist() for n in names], strict=True))
    want = sorted(tuple(repr(r[columns.index(n)]) for n in names) for r in done.fetchall())
    assert got == want
