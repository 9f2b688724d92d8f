"""Every query of the engine against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from sparkloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return made


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value if value is None or isinstance(value, str | bool | int) else float(value) if hasattr(value, "as_tuple") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    rows = rows_of(found.columns, found.collect())
    if name in plans.ORACLE_SQL:
        result = duck.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        expected = rows_of(names, result.fetchall())
        assert rows[0] == expected[0]
        assert [r.replace(".0", "") for r in rows[1]] == [r.replace(".0", "") for r in expected[1]]
