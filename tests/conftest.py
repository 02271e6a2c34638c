from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    made = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf() -> str:
    return DATA


class Oracle:
    """Runs a query on both engines and compares rows, whatever their order."""

    def __init__(self, spark: SparkSession, sf: str):
        import duckdb

        self.spark, self.sf, self.db = spark, sf, duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            self.db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    @staticmethod
    def _plain(value):
        if isinstance(value, float):
            return round(value, 6)
        return tuple(map(Oracle._plain, value)) if isinstance(value, (list, tuple)) else value

    def check(self, query, sql: str) -> None:
        df = query(self.spark, self.sf)
        names = sorted(df.columns)
        want = self.db.sql(sql)
        assert names == sorted(want.columns)
        got = sorted((tuple(self._plain(r[n]) for n in names) for r in df.collect()), key=str)
        expected = sorted((tuple(self._plain(x) for x in r) for r in want.select(*[f'"{n}"' for n in names]).fetchall()), key=str)
        assert got == expected


@pytest.fixture(scope="session")
def oracle(spark, sf) -> Oracle:
    return Oracle(spark, sf)
