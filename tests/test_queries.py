"""Every registered query runs, and those with SQL give the same rows as DuckDB."""
import pytest
from oracle import compare

from evigraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        rows, differences = compare(df, ORACLES[name], SF)
        assert not differences, differences
    else:
        assert df.collect() is not None
