import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(sql: str, sf_dir: str):
        con = duckdb.connect()
        for name in tables:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return [columns[i] for i in order], sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found.fetchall()), key=str)

    return run


@pytest.fixture(scope="session")
def rows_of():
    def run(df):
        columns = sorted(df.columns)
        return columns, sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=str)

    return run
