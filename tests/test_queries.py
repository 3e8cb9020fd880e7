import pytest

from quarrylog.plans import findings, history, operations, rankings, registry, texts, timelines  # noqa: F401
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["bucket", "count", "z", "before_rate", "after_rate"]
    assert rows.count() > 0


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
