import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tesserae.session import session

    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows_of(pdf, columns):
    """Rows as sorted tuples of text, numbers without their kind."""

    def one(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in pdf[columns].itertuples(index=False))
