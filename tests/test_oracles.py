import pytest

from quorumtab.plans import driver_queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_duckdb(name, spark, sf_dir, same_rows):
    same_rows(q.QUERIES[name](spark, sf_dir), q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_has_rows(name, spark, sf_dir):
    assert q.QUERIES[name](spark, sf_dir).count() > 0


def test_rms_f1_scores_every_further_sample(spark, sf_dir, duck):
    want = duck.execute("""
        SELECT DISTINCT l_suppkey || '-' || (l_linenumber - 1) FROM lineitem
        WHERE l_linenumber > (SELECT min(x.l_linenumber) FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey)""").fetchall()
    assert sorted(r.pair_id for r in q.q_rms_f1(spark, sf_dir).collect()) == sorted(x for (x,) in want)
