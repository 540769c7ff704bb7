from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from opsloom.session import session

    folder = tmp_path_factory.mktemp("shared")
    s = session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(folder), "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def _folder(spark, tmp, rows: bool) -> str:
    """The tables with their types, without rows, or with one row of nulls."""
    for path in Path(SMALL).glob("*.parquet"):
        t = spark.read.parquet(str(path))
        one = [tuple([None] * len(t.columns))] if rows else []
        nullable = t.schema
        for f in nullable.fields:
            f.nullable = True
        spark.createDataFrame(one, nullable).coalesce(1).write.parquet(f"{tmp}/{path.name}")
    return str(tmp)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    return _folder(spark, tmp_path_factory.mktemp("empty"), False)


@pytest.fixture(scope="session")
def null_tables(spark, tmp_path_factory):
    return _folder(spark, tmp_path_factory.mktemp("nulls"), True)
