import compare
import pytest
from inkwright.plans import registry

SLOW = {"page_match_kinds", "conversion", "reading_order", "clean_regions"}  # have tests of their own


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(name, spark, sf_dir, con):
    assert compare.differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(name, spark, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
