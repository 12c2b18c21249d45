"""General relational operators: joins of every kind, grouping sets, set operations, windows, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.interval import interval_join
from ..session import table
from .catalogue import query


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
       round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query("""
select o_orderkey, o_custkey, round(o_totalprice, 2) as price from orders order by o_totalprice desc, o_orderkey limit 100""")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("""
select coalesce(r_name, '*') as region, coalesce(n_name, '*') as nation, count(*) as orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by rollup(r_name, n_name)""")
def orders_rollup(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("p"))  # one row a customer before the joins
    j = per.join(c, per.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = j.rollup("r_name", "n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("p"), 2).alias("total"))
    return out.select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), "orders", "total")


@query("""
select coalesce(c_mktsegment, '*') as segment, coalesce(o_orderpriority, '*') as priority, count(*) as n
from orders join customer on o_custkey = c_custkey group by cube(c_mktsegment, o_orderpriority)""")
def orders_cube(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    out = o.join(c, o.o_custkey == c.c_custkey).cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("""
(select c_nationkey as k, 'both' as part from customer intersect select s_nationkey, 'both' from supplier)
union all (select k, 'customers only' from (select c_nationkey as k from customer except select s_nationkey from supplier))
union all (select k, 'either' from (select c_nationkey as k from customer union select s_nationkey from supplier))""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(c.intersect(s), "both").unionByName(part(c.subtract(s), "customers only")).unionByName(part(c.union(s).distinct(), "either"))


@query("""
select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as has_finished from customer
where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def semi_and_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    state = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("f"), F.max(F.col("o_orderstatus") == "P").alias("p"))
    # Both subqueries read one aggregate of the orders, so these are shuffled once.
    return c.join(state, "c_custkey", "left").where(~F.coalesce("p", F.lit(False))).select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_finished"))


@query("""
select s_suppkey, rank() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as place,
       round(sum(s_acctbal) over (partition by s_nationkey order by s_acctbal desc, s_suppkey rows unbounded preceding), 2) as running from supplier""")
def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    total = F.sum("s_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).alias("place"), F.round(total, 2).alias("running"))


@query("""
select count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(distinct l_orderkey) as orders, l_returnflag from lineitem group by l_returnflag""")
def distinct_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"))


@query("""
select e.event_id, max(p.event_id) as last_purchase from events e left join
  (select a.event_id as id, arg_max(b.event_id, (b.ts, b.event_id)) as event_id from events a join events b
   on a.user_id = b.user_id and b.event_type = 'purchase' and (b.ts, b.event_id) < (a.ts, a.event_id) where a.event_type = 'error' group by a.event_id) p
  on e.event_id = p.id where e.event_type = 'error' group by e.event_id""")
def asof_join_events(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase of the same user before each error: one sorted pass over a user's events instead of a range join."""
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'error'").select("event_id", "last_purchase")


@query("""
select a.event_id as signup_id, count(b.event_id) as views_within_day from events a left join events b
on a.user_id = b.user_id and b.event_type = 'view' and b.ts > a.ts and b.ts <= a.ts + interval 1 day where a.event_type = 'signup' group by a.event_id""")
def interval_join_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("t0"), (F.col("ts") + F.expr("interval 1 day")).alias("t1"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "ts")
    near = interval_join(a, b, ["user_id"], "t0", "t1", "ts", 86400).groupBy("signup_id").agg(F.count("view_id").alias("views_within_day"))
    return a.select("signup_id").join(near, "signup_id", "left").select("signup_id", F.coalesce("views_within_day", F.lit(0)).alias("views_within_day"))


@query("""
with recursive up(k, root, depth) as (select l_suppkey, l_suppkey, 0 from lineitem group by 1 union all select k // 2, root, depth + 1 from up where k > 1)
select root as supplier, max(depth) as depth, count(*) as steps from up group by root""")
def recursive_levels(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").select("l_suppkey").distinct()
    return spark.sql(
        """with recursive up(k, root, depth) max recursion level 200 as (select l_suppkey, l_suppkey, 0 from {keys} union all select k div 2, root, depth + 1 from up where k > 1)
        select root as supplier, max(depth) as depth, count(*) as steps from up group by root""",
        keys=keys,
    )


@query("""
select p_brand, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as urgent, sum(case when o_orderpriority = '5-LOW' then 1 else 0 end) as low
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by p_brand""")
def pivoted_priorities(spark: SparkSession, d: str) -> DataFrame:
    l, o, p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), table(spark, d, "part").select("p_partkey", "p_brand")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    out = j.groupBy("p_brand").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("p_brand"))
    return out.select("p_brand", F.coalesce(F.col("1-URGENT"), F.lit(0)).alias("urgent"), F.coalesce(F.col("5-LOW"), F.lit(0)).alias("low"))
