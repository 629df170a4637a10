import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def agree(df, con, sql):
    """Whether a Spark result and SQL give the same columns and rows, in any order."""
    asked = con.execute(sql)
    names = [c[0] for c in asked.description]
    assert sorted(df.columns) == sorted(names)
    other = asked.fetchall()
    rows = lambda found, cols: sorted(repr([r[i] for i in sorted(range(len(cols)), key=cols.__getitem__)]) for r in found)
    assert rows(df.collect(), df.columns) == rows(other, names)


def positions(df, column="position"):
    return sorted(r[column] for r in df.select(column).collect())
