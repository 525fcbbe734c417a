import re

from veilspan.operators import dictionary
from veilspan.plans import scoring
from veilspan.plans import world as V
from veilspan.plans.base import DEALT_ROWS, Tables


def test_labelled_rows_and_model_spans_are_rendered_in_parts(spark, tmp_path):
    n = 2 * DEALT_ROWS + 1
    spark.range(n).selectExpr("id as o_orderkey", "id % 100 as o_custkey").coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("*.parquet"))
    (tmp_path / "orders.parquet").symlink_to(part)
    t = Tables(spark, str(tmp_path))
    for rows in (V.cases(t).select("row_id", "current"), V.model_spans(t)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 3, true" in plan
    assert V.cases(t).count() == n


def _small(spark, tmp_path, orders=40, matters=10):
    for name, rows in (("orders", spark.range(orders).selectExpr("id as o_orderkey", f"id % {matters} as o_custkey")), ("customer", spark.range(matters).selectExpr("id as c_custkey", "'HOUSEHOLD' as c_mktsegment"))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / f"{name}.parquet").symlink_to(next((tmp_path / name).glob("*.parquet")))
    return Tables(spark, str(tmp_path))


def test_a_catalog_over_the_bound_is_not_broadcast(spark, tmp_path, monkeypatch):
    t = _small(spark, tmp_path)
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", 0)
    plan = scoring._scored(t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [matter_id" in plan and not re.search(r"BroadcastHashJoin \[(matter_id|entity|_found)", plan)


def test_letters_meet_their_model_spans_in_one_join(spark, tmp_path):
    spans = V.model_spans(_small(spark, tmp_path))
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    count = {r["detector"]: r["count"] for r in spans.groupBy("detector").count().collect()}
    assert count == {"prompt": 30, "base": 20 + 14, "tuned": 26 + 8}
