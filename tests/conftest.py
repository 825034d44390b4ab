import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Asserts that a DataFrame and a DuckDB statement give the same bag of rows under the same column names."""

    def norm(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "0") if v == 0 else f"{v:.6f}"
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (list, tuple)):
            return [norm(x) for x in v]
        return str(v)

    def check(df, sql):
        mine = df.collect()
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        theirs = cur.fetchall()
        assert sorted(df.columns) == sorted(names)
        cols = sorted(names)
        a = sorted(str([norm(r[c]) for c in cols]) for r in mine)
        b = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in theirs)
        assert len(a) == len(b), (len(a), len(b))
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        assert not bad, bad[:3]

    return check
