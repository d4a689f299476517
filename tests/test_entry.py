import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert "rank_recommend_topk" in queries and set(oracles) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
