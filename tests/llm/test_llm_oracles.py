import pytest

from quorumtab.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(name, spark, sf_dir, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])
