import re

import pytest

from lodestone.operators import relational, retrieval
from lodestone.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(relational.count_gt_window(spark, FOLDER))
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert re.search(r"ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>", plan)
    plan = plan_of(relational.revenue_total(spark, FOLDER))
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double>" in plan


@pytest.mark.parametrize("name", ["revenue_topk_supplier", "qty_group_topk", "lowest_group", "margin_topk", "topk_customer_grain"])
def test_top_k_is_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan_of(getattr(relational, name)(spark, FOLDER))


@pytest.mark.parametrize("name", [n for n in dir(relational) if n in ("revenue_topk_supplier", "aov_current", "semi_exists", "anti_orders", "window_running_sum", "reporting_group_rollup", "pct_discounted")])
def test_nothing_leaves_the_jvm(spark, name):
    plan = plan_of(getattr(relational, name)(spark, FOLDER))
    assert not re.search("Python|Pandas|BatchEval|CartesianProduct", plan)


def test_bm25_meets_queries_by_token(spark):
    plan = plan_of(retrieval.bm25(table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark"), 5, "doc_id", "text", "item_id", "text"))
    assert "CartesianProduct" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["qty_group_topk", "revenue_type_window"])
def test_lines_are_filtered_at_run_time_where_orders_are_too_many_to_broadcast(spark, name):
    """The bounds of orders become a filter of lines before these are shuffled; the sizes from which Spark does so are set to those of the tests."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        assert "might_contain" in plan_of(getattr(relational, name)(spark, FOLDER))
    finally:
        for key in small:
            spark.conf.unset(key)


def test_keys_without_a_row_do_not_count_among_the_best(spark, tmp_path):
    for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"):
        table(spark, FOLDER, t).write.parquet(f"{tmp_path}/{t}.parquet")
    best = {n: getattr(relational, n)(spark, FOLDER).first()[0] for n in ("revenue_topk_supplier", "topk_customer_grain", "margin_topk")}
    table(spark, FOLDER, "supplier").filter(f"s_suppkey <> {best['revenue_topk_supplier']}").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    table(spark, FOLDER, "customer").filter(f"c_custkey NOT IN ({best['topk_customer_grain']}, {best['margin_topk']})").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    assert [getattr(relational, n)(spark, str(tmp_path)).count() for n in best] == [5, 3, 1]
