import duckdb
import pytest

DATA = SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def oracle():
    from quarry.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture
def write(spark, tmp_path):
    """write(name, rows, schema) puts a small table where queries look for it."""
    def go(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return go
