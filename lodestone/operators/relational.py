"""Questions over orders, lines, parts, customers and suppliers, as DataFrame operations.

Sums of money are exact; every top-k has a key as tie-break; a label is shown beside the key that is grouped by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import amount, as_date, cents, julian_day, like, money, strftime
from lodestone.functions.columns import total as total_of
from lodestone.sources.tables import table

#: A campaign's window over the order dates, and the reporting group that combines two part types.
WINDOW = ("1997-06-01", "1997-06-30")
GROUP = {"name": "Heavy", "members": ["LARGE", "STANDARD"]}


def _revenue():
    return money("l_extendedprice", "l_discount")


def _in_window(date: str = "o_orderdate"):
    return F.col(date).cast("date").between(*(F.lit(x).cast("date") for x in WINDOW))


def _with_type(spark, d, lines):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return lines.join(p, lines.l_partkey == p.p_partkey)


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _revenue_of_types(spark, d, lines):
    """Sums of all lines by part, which are then few, joined with the parts' types."""
    return _with_type(spark, d, lines.groupBy("l_partkey").agg(F.sum(_revenue()).alias("revenue")))


def count_all(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


def count_eq(spark, d):
    return table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").agg(F.count("*").alias("n"))


def count_gt_window(spark, d):
    return table(spark, d, "orders").filter((F.col("o_totalprice") > 100000) & _in_window()).agg(F.count("*").alias("n"))


def revenue_total(spark, d):
    return table(spark, d, "lineitem").agg(amount(F.sum(_revenue())).alias("revenue"))


def revenue_type_window(spark, d):
    return _with_type(spark, d, _window_lines(spark, d)).groupBy("p_type").agg(amount(F.sum(_revenue())).alias("revenue"))


def qty_group_topk(spark, d):
    return _with_type(spark, d, _window_lines(spark, d)).groupBy("p_type").agg((F.sum(cents(F.col("l_quantity"))) / 100).alias("quantity")).orderBy(F.desc("quantity"), "p_type").limit(3)


def lowest_group(spark, d):
    return _revenue_of_types(spark, d, table(spark, d, "lineitem")).groupBy("p_type").agg(amount(F.sum("revenue")).alias("revenue")).orderBy("revenue", "p_type").limit(1)


def revenue_topk_supplier(spark, d):
    """Lines are summed by key and the five best kept before names are joined; keys without a supplier don't count among the five."""
    li, s, n, r = _t(spark, d, "lineitem", "supplier", "nation", "region")
    sums = li.groupBy("l_suppkey").agg(amount(F.sum(_revenue())).alias("revenue"))
    best = sums.join(s.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").orderBy(F.desc("revenue"), "l_suppkey").limit(5)
    named = s.join(F.broadcast(best), s.s_suppkey == best.l_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)  # five rows
    return named.select("s_suppkey", F.col("s_name").alias("supplier"), F.col("r_name").alias("region"), "revenue").orderBy(F.desc("revenue"), "s_suppkey")


def topk_customer_grain(spark, d):
    """The three best customers by key; names are joined last, keys without a customer don't count."""
    o, c, li = _t(spark, d, "orders", "customer", "lineitem")
    per_order = li.groupBy("l_orderkey").agg(F.sum(_revenue()).alias("revenue"))
    per_customer = per_order.join(o, per_order.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(amount(F.sum("revenue")).alias("revenue"))
    best = per_customer.join(_keys(c), "o_custkey", "left_semi").orderBy(F.desc("revenue"), "o_custkey").limit(3)
    return c.join(F.broadcast(best), best.o_custkey == c.c_custkey).select("c_custkey", F.col("c_name").alias("customer"), "revenue").orderBy(F.desc("revenue"), "c_custkey")  # three rows


def _keys(customers):
    return customers.select(F.col("c_custkey").alias("o_custkey"))


def _window_lines(spark, d):
    li, o = _t(spark, d, "lineitem", "orders")
    return li.join(o.filter(_in_window()), li.l_orderkey == o.o_orderkey)


def aov_current(spark, d):
    """Lines are summed by order first, so that orders are counted without expanding rows."""
    per_order = _window_lines(spark, d).groupBy("o_orderkey").agg(F.sum(_revenue()).alias("revenue"))
    rows = per_order.agg(amount(F.sum("revenue")).alias("revenue"), F.count("*").alias("orders"))
    return rows.select("revenue", "orders", F.round(F.try_divide("revenue", "orders").cast("decimal(18,6)"), 2).cast("double").alias("aov"))


def aov_legacy(spark, d):
    per_order = _window_lines(spark, d).groupBy("o_orderkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("gross"))
    rows = per_order.agg((F.sum(F.col("gross").cast("decimal(18,0)")) / 100).cast("double").alias("gross"), F.count("*").alias("orders"))
    return rows.select("gross", "orders", F.round(F.try_divide("gross", "orders").cast("decimal(18,6)"), 2).cast("double").alias("aov"))


def margin_topk(spark, d):
    cost = cents(F.col("l_extendedprice")) * 70  # 0.7 of the price, in ten-thousandths
    c = table(spark, d, "customer")
    sums = _window_lines(spark, d).groupBy("o_custkey").agg(amount(F.sum(_revenue() - cost)).alias("margin"))
    best = sums.join(_keys(c), "o_custkey", "left_semi").orderBy(F.desc("margin"), "o_custkey").limit(1)
    return c.join(F.broadcast(best), best.o_custkey == c.c_custkey).select("c_custkey", F.col("c_name").alias("customer"), "margin")  # one row


def pct_discounted(spark, d):
    rows = table(spark, d, "lineitem").agg(F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("hits"), F.count("*").alias("n"))
    return rows.select("hits", "n", (F.col("hits") * 100.0 / F.col("n")).cast("double").alias("pct"))


def lines_vs_orders(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"))


def having_alias(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts")).filter("parts >= 5").orderBy("p_brand")


def reporting_group_count(spark, d):
    member = F.col("p_type").isin(GROUP["members"])
    return table(spark, d, "part").agg(F.count_distinct(F.when(member, F.col("p_partkey"))).alias("parts"), F.count_distinct(F.when(member, F.col("p_brand"))).alias("brands"))


def reporting_group_rollup(spark, d):
    group = F.create_map(*(F.lit(x) for m in GROUP["members"] for x in (m, GROUP["name"])))
    lines = _revenue_of_types(spark, d, table(spark, d, "lineitem"))
    return lines.groupBy(F.coalesce(F.element_at(group, F.col("p_type")), F.col("p_type")).alias("reporting_group")).agg(amount(F.sum("revenue")).alias("revenue"))


def null_predicate(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return joined.agg(F.count_if(F.col("n").isNull()).alias("without_lines"), F.count_if(F.col("n").isNotNull()).alias("with_lines"))


def in_list(spark, d):
    return table(spark, d, "part").filter(F.col("p_size").isin(1, 5, 10)).groupBy("p_size").agg(F.count("*").alias("n"))


def like_ci(spark, d):
    return table(spark, d, "part").filter(like(F.col("p_name"), "%RED%") | like(F.col("p_type"), "%anodized%") | like(F.col("p_name"), "part 1%")).agg(F.count("*").alias("n"))


def case_expr(spark, d):
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, d, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


def semi_in(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    big = o.filter(F.col("o_totalprice") > 300000).select("o_custkey")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").agg(F.count("*").alias("n"))


def semi_exists(spark, d):
    p, li = _t(spark, d, "part", "lineitem")
    bulk = li.filter(F.col("l_quantity") >= 49)
    return p.join(bulk, p.p_partkey == bulk.l_partkey, "left_semi").groupBy("p_type").agg(F.count("*").alias("n"))


def anti_orders(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey", "o_orderstatus")


def left_join_count(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").groupBy(F.coalesce("k", F.lit(0)).alias("orders")).agg(F.count("*").alias("customers"))


def right_join_count(spark, d):
    c, n = _t(spark, d, "customer", "nation")
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return per.join(n, per.c_nationkey == n.n_nationkey, "right").select("n_name", F.coalesce("k", F.lit(0)).alias("customers"))


def full_join_count(spark, d):
    s, c = _t(spark, d, "supplier", "customer")
    a = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    b = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return a.join(b, a.s_nationkey == b.c_nationkey, "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nationkey"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


def cross_const(spark, d):
    """A join without a condition, of two tables whose sizes are fixed: 5 regions and 25 nations."""
    r, n = _t(spark, d, "region", "nation")
    return r.crossJoin(n).agg(F.count("*").alias("n"))


def using_join(spark, d):
    documents, labels = _t(spark, d, "documents", "labels")
    return documents.join(labels, on=["doc_id"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def natural_join(spark, d):
    documents, labels = _t(spark, d, "documents", "labels")
    return documents.select("doc_id", "lang").join(labels.select("doc_id", "quality"), on=["doc_id"]).groupBy("lang", "quality").agg(F.count("*").alias("n"))


def self_join_nation(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).groupBy(F.col("a.n_regionkey").alias("n_regionkey")).agg(F.count("*").alias("pairs"))


def comma_join(spark, d):
    n, r = _t(spark, d, "nation", "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("n"))


def derived_join(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    per = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("largest"))
    return c.join(per, c.c_custkey == per.o_custkey).groupBy("c_mktsegment").agg(F.max("largest").alias("largest"))


def scalar_subquery(spark, d):
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("top"))
    return o.join(F.broadcast(top), o.o_totalprice == top.top).select("o_orderkey", "o_totalprice")


def cte_multi(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("lodestone_orders")
    return spark.sql("WITH big AS (SELECT o_custkey FROM lodestone_orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n")


def cte_shadow(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("lodestone_orders")
    return spark.sql("WITH lodestone_orders AS (SELECT * FROM lodestone_orders WHERE o_orderstatus = 'F') SELECT COUNT(*) AS n FROM lodestone_orders")


def cte_recursive(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("lodestone_orders")
    return spark.sql("WITH RECURSIVE years(y) AS (SELECT 1995 UNION ALL SELECT y + 1 FROM years WHERE y < 2001) SELECT y, COUNT(o_orderkey) AS n FROM years LEFT JOIN lodestone_orders ON year(o_orderdate) = y GROUP BY y")


def union_all(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    both = o.select(F.year("o_orderdate").alias("y")).unionAll(li.select(F.year("l_shipdate").alias("y")))
    return both.groupBy("y").agg(F.count("*").alias("n"))


def union_distinct(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


def intersect_keys(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    return o.select(F.col("o_orderkey").alias("k")).intersect(li.select("l_orderkey")).agg(F.count("*").alias("n"))


def except_keys(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    return o.select(F.col("o_orderkey").alias("k")).subtract(li.select("l_orderkey"))


def window_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).filter("rank <= 2")


def window_running_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(14,2)")).over(w).cast("double").alias("running"))


def order_offset(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")).orderBy(F.asc_nulls_first("balance"), "c_custkey").offset(5).limit(20)


def date_half_open(spark, d):
    day = F.col("o_orderdate").cast("string")
    return table(spark, d, "orders").filter((day >= WINDOW[0]) & (day < "1997-07-01")).agg(F.count("*").alias("n"))


def _mixed_dates(spark, d):
    """Order dates as text in two formats, as loose sources have them."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    return o.withColumn("dated", F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 101 == 0, F.lit("unknown")).otherwise(F.concat(day, F.lit(" 12:00:00"))))


def date_mixed_text(spark, d):
    days = as_date(F.col("dated")).between(*(F.lit(x).cast("date") for x in WINDOW))
    return _mixed_dates(spark, d).agg(F.count_if(days).alias("by_day"), F.count_if(F.col("dated").between(*WINDOW)).alias("as_text"), F.count_if(as_date(F.col("dated")).isNull()).alias("unparsable"))


def strftime_year(spark, d):
    return _mixed_dates(spark, d).groupBy(strftime("%Y-%m", as_date(F.col("dated"))).alias("month")).agg(F.count("*").alias("n"))


def julian(spark, d):
    return table(spark, d, "orders").select("o_orderkey", julian_day(F.col("o_orderdate")).alias("day"))


def aggregates(spark, d):
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.sum(price).cast("double").alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("over"))


def total_of_none(spark, d):
    return table(spark, d, "orders").filter("o_totalprice < 0").agg(total_of(F.col("o_totalprice")).alias("total"), F.count("*").alias("n"))


def scalar_functions(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(F.substring("c_name", 1, 4)).alias("head"), F.length("c_name").alias("n"), F.abs(F.round(F.col("c_acctbal").cast("decimal(12,2)"), 0)).cast("double").alias("size"),
        F.ifnull(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"), F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("short"), F.trim(F.lower("c_mktsegment")).alias("lower"),
        F.printf(F.lit("%05d"), F.col("c_custkey")).alias("padded"), F.concat_ws("|", "c_mktsegment", "c_name").alias("joined"),
    )


def glob_match(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").rlike("^Customer#0*[1-4][0-9]?$")).select("c_custkey", "c_name")


def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


def multiset_diff(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    a, b = o.select(F.year("o_orderdate").alias("y"), "o_orderstatus"), o.filter("o_orderkey % 2 = 0").select(F.year("o_orderdate").alias("y"), "o_orderstatus")
    return a.exceptAll(b).groupBy("y", "o_orderstatus").agg(F.count("*").alias("n"))
