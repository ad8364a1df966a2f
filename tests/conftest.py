import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="lingrove-tests-")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def trained(con, sql):
    """The same SQL with the common steps of training read from tables, which are made once."""
    from lingrove.plans import oracle, queries

    for name, steps in (("halves", queries.HALVES), ("model", oracle.MODEL)):
        if sql.startswith(steps):
            if not con.execute("select 1 from duckdb_schemas() where schema_name = ?", [name]).fetchall():
                con.execute(f"create schema {name}")
                for t in ("h", "tot", "ids", "tri", "bi", "mo"):
                    con.execute(f"create table {name}.{t} as {steps} select * from {t}")
            con.execute(f"set search_path = '{name},main'")
            return "with _ as (select 1)" + sql.removeprefix(steps)
    con.execute("set search_path = 'main'")
    return sql


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, bytearray):
        return bytes(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's whole result against its SQL."""

    def check(query, sql):
        got = query(spark, DATA)
        found = duck.execute(trained(duck, sql))
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(got.columns)
        at = [names.index(c) for c in got.columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert sorted((tuple(map(plain, r)) for r in got.collect()), key=repr) == want

    return check
