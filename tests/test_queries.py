"""Every raster query against its SQL, over the smallest tables."""

import duckdb
import pytest

from terraframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slower ones, held at the larger scale by the driver, run here in their cheaper forms only.
QUERIES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    show = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, small, duck, name):
    found = registry.queries()[name](spark, small).toPandas()
    wanted = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
