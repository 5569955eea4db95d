"""Opportunity features join no exploded pairs back to their targets."""

from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_one_row_a_target(spark):
    import __spark_entry__ as entry

    fn, sql = entry.queries()["opportunity_features"], entry.oracle_sql()["opportunity_features"]
    plan = fn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert compare(spark, duck(SF), SF, fn, sql).startswith("ok")
