import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from lorekeep.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def rows(values, columns):
    """Rows as comparable tuples: numbers to nine digits, lists as tuples."""
    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    return sorted((tuple(plain(v[c]) for c in columns) for v in values), key=lambda r: [(x is None, str(x)) for x in r])


def same(spark, duck, query, sql):
    df = query(spark, SMALL)
    columns = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    theirs = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert rows(df.collect(), columns) == rows(theirs, columns)
