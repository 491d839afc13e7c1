"""Every query of the library against its SQL on the smallest tables, and rules of the source."""

import os
import re
from pathlib import Path

import pytest

from tidemark.plans import catalogue

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent / "tidemark"


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    found = duckdb.connect()
    for name in os.listdir(DATA):
        found.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return found


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sql, name):
    rows = catalogue.QUERIES[name](spark, DATA)
    want = sql.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert columns == rows.columns
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    as_text = lambda found: sorted(repr(tuple(map(near, r))) for r in found)
    assert as_text(map(tuple, rows.collect())) == as_text(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_code_has_no_udf_and_no_cache():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.parts:
            continue
        text = path.read_text()
        assert not re.search(r"toPandas|applyInPandas|mapInPandas|\.cache\(|tidemark\.llm", text), path
        # The trees alone count in Arrow batches inside tasks, and keep a level's histograms until its round ends.
        if path.name != "boosting.py":
            assert not re.search(r"pandas_udf|mapInArrow|applyInArrow|\.persist\(", text), path
