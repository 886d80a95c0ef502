import os
import sys

import duckdb
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [REPO, os.path.join(REPO, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, [os.environ.get("PYTHONPATH")])])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": f"local[{os.environ.get('TEST_CPUS', '4')}]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


def plain(columns, rows):
    """Columns by name and rows in order, doubles rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    found = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Runs a query and its SQL and compares them."""

    def check(query, sql):
        df = query(spark, SF)
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(columns, want.fetchall())

    return check
