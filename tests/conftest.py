import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sql, sf_dir=SF):
        c = duckdb.connect()
        c.sql("set timezone='UTC'")
        for name in sorted(os.listdir(sf_dir)):
            table = name.removesuffix(".parquet")
            at = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            c.sql(f"create view {table} as select * from read_parquet('{at}')")
        return c.sql(sql).fetchdf()

    return run


def normal(df):
    """Rows as sorted tuples by column name, with comparable values."""
    import math

    import numpy as np
    import pandas as pd

    def plain(v):
        if isinstance(v, np.ndarray):
            return tuple(plain(x) for x in v)
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return int(v)
        if isinstance(v, (float, np.floating)):
            return int(v) if float(v).is_integer() else round(float(v), 6)
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return v

    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="session")
def same(duck):
    """same(spark frame, sql): equal columns and bags of rows."""

    def check(df, sql, sf_dir=SF):
        got, want = normal(df.toPandas()), normal(duck(sql, sf_dir))
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]

    return check
