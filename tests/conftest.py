import datetime
import glob
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session, ship

    s = ship(local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same():
    return lambda a, b: rows(a) == rows(b)
