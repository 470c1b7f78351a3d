import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from datadict.session import local  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture()
def evaluate(spark):
    """Evaluate column expressions over rows: `evaluate(rows, schema, column)` gives a list."""

    def run(rows, schema, column):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        return [r["out"] for r in df.select("_i", column.alias("out")).orderBy("_i").collect()]

    return run
