"""The relational shapes: scans, predicates, joins, aggregates, order, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import count_where, int_div, percent_where, safe_ratio, sum_where
from ..functions.ordering import pg_asc, pg_desc
from ..functions.temporal import lap_seconds, seconds_between, year_gap, year_text
from ..operators.joins import above_average, matching, not_in, share_of_total, top_ranked
from ..operators.results import with_unique_names
from .registry import query

c = F.col


def money(column):
    return c(column).cast("decimal(12,2)")


def revenue():
    """Exact, so the sum does not depend on how the rows are spread."""
    return money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - c("l_discount").cast("decimal(4,2)"))


REVENUE_SQL = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


@query("topk_sum_by_nation", f"""
    SELECT n_name, CAST(SUM({REVENUE_SQL}) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def topk_sum_by_nation(t):
    """Sums move up join by join: each shuffle carries one row per key."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    per_customer = (
        per_order.join(t.orders, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r")))
    return (
        per_customer.join(t.customer, c("o_custkey") == c("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("r").alias("r"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .groupBy("n_name").agg(F.sum("r").cast("double").alias("revenue"))
        .orderBy(pg_desc("revenue"), pg_asc("n_name")).limit(10))


@query("scan_all", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def scan_all(t):
    from ..session import TABLES

    out = None
    for name in TABLES:
        one = getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_predicates", """
    SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS q, l_extendedprice * l_discount AS off,
           l_extendedprice / l_quantity AS unit
    FROM lineitem
    WHERE (l_quantity BETWEEN 5 AND 30 AND l_returnflag IN ('A', 'R') AND l_linenumber <> 3
           AND l_quantity + l_linenumber > 12) OR (l_discount >= 0.09 AND NOT l_tax < 0.07)""")
def filter_predicates(t):
    return t.lineitem.filter(
        (c("l_quantity").between(5, 30) & c("l_returnflag").isin("A", "R") & (c("l_linenumber") != 3)
         & (c("l_quantity") + c("l_linenumber") > 12))
        | ((c("l_discount") >= 0.09) & ~(c("l_tax") < 0.07))
    ).select(
        "l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("q"),
        (c("l_extendedprice") * c("l_discount")).alias("off"),
        (c("l_extendedprice") / c("l_quantity")).alias("unit"))


@query("like_ilike", """
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE (p_brand LIKE 'Brand#_' AND p_name ILIKE '%RING%') OR p_type LIKE 'S%D'""")
def like_ilike(t):
    return t.part.filter(
        (c("p_brand").like("Brand#_") & c("p_name").ilike("%RING%")) | c("p_type").like("S%D")
    ).select("p_partkey", "p_name", "p_brand")


@query("bool_null_predicates", """
    SELECT o_orderkey, first_ship IS NULL AS unshipped, early FROM (
      SELECT o_orderkey, o_orderdate, MIN(l_shipdate) AS first_ship, MIN(l_shipdate) < o_orderdate AS early
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate) s
    WHERE first_ship IS NULL OR early = true OR NOT (first_ship < o_orderdate)""")
def bool_null_predicates(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    rows = t.orders.join(first, c("o_orderkey") == c("l_orderkey"), "left").withColumn(
        "early", c("first_ship") < c("o_orderdate"))
    return rows.filter(c("first_ship").isNull() | c("early") | ~(c("first_ship") < c("o_orderdate"))).select(
        "o_orderkey", c("first_ship").isNull().alias("unshipped"), "early")


@query("ts_half_open", """
    SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (WHERE CAST(o_orderdate AS DATE) = DATE '1996-02-29') AS leap
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    GROUP BY o_orderpriority""")
def ts_half_open(t):
    start, end = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")
    return t.orders.filter((c("o_orderdate") >= start) & (c("o_orderdate") < end)).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.to_date("o_orderdate") == F.lit("1996-02-29").cast("date")).alias("leap"))


@query("in_subquery", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_orderpriority = '1-URGENT')""")
def in_subquery(t):
    big = t.orders.filter((c("o_totalprice") > 400000) & (c("o_orderpriority") == "1-URGENT"))
    return matching(t.customer, big, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("not_in_subquery", """
    SELECT o_orderkey, o_custkey FROM orders WHERE NOT o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def not_in_subquery(t):
    return not_in(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query("not_in_with_nulls", """
    SELECT COUNT(*) AS n FROM orders
    WHERE o_orderkey NOT IN (SELECT NULLIF(l_orderkey, (SELECT MAX(l_orderkey) FROM lineitem)) FROM lineitem)""")
def not_in_with_nulls(t):
    """A null in the list leaves nothing."""
    last = t.lineitem.agg(F.max("l_orderkey")).scalar()
    listed = t.lineitem.select(F.when(c("l_orderkey") != last, c("l_orderkey")).alias("k"))
    return not_in(t.orders, listed, "o_orderkey", "k").agg(F.count(F.lit(1)).alias("n"))


@query("not_exists", """
    SELECT o_orderkey FROM orders WHERE NOT EXISTS (
      SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def not_exists(t):
    returned = t.lineitem.filter(c("l_returnflag") == "R")
    return matching(t.orders, returned, "o_orderkey", "l_orderkey", keep=False).select("o_orderkey")


@query("scalar_max", """
    SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)
       OR p_retailprice = (SELECT MIN(p_retailprice) FROM part WHERE p_size > 25)""")
def scalar_max(t):
    top = t.part.agg(F.max("p_retailprice")).scalar()
    low = t.part.filter("p_size > 25").agg(F.min("p_retailprice")).scalar()
    return t.part.filter((c("p_retailprice") == top) | (c("p_retailprice") == low)).select(
        "p_partkey", "p_name", "p_retailprice")


@query("scalar_plain_lt", """
    SELECT s_suppkey FROM supplier WHERE s_acctbal < (SELECT c_acctbal FROM customer WHERE c_name = 'Customer#000000001')""")
def scalar_plain_lt(t):
    one = t.customer.filter(c("c_name") == "Customer#000000001").select("c_acctbal").scalar()
    return t.supplier.filter(c("s_acctbal") < one).select("s_suppkey")


@query("nested_subqueries", """
    SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (
      SELECT c_nationkey FROM customer WHERE c_custkey IN (
        SELECT o_custkey FROM orders WHERE o_totalprice >= (
          SELECT 0.99 * MAX(o_totalprice) FROM orders WHERE o_orderstatus = 'F')))""")
def nested_subqueries(t):
    bound = t.orders.filter(c("o_orderstatus") == "F").agg(F.lit(0.99) * F.max("o_totalprice")).scalar()
    buyers = t.orders.filter(c("o_totalprice") >= bound)
    nations = matching(t.customer, buyers, "c_custkey", "o_custkey")
    return matching(t.supplier, nations, "s_nationkey", "c_nationkey").select("s_suppkey", "s_name")


@query("argmax_over_join", """
    SELECT n_name, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE s_acctbal = (SELECT MAX(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey
                       JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def argmax_over_join(t):
    homes = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"))
    best = (
        homes.join(t.region, c("n_regionkey") == c("r_regionkey")).filter(c("r_name") == "ASIA")
        .agg(F.max("s_acctbal")).scalar())
    return homes.filter(c("s_acctbal") == best).select("n_name", "s_name", "s_acctbal")


@query("share_of_total", """
    SELECT o_orderpriority, ROUND(SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders), 8) AS share
    FROM orders GROUP BY o_orderpriority""")
def share_of_total_query(t):
    sums = t.orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    return share_of_total(sums, "v").select("o_orderpriority", F.round("share", 8).alias("share"))


@query("above_average", """
    SELECT s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE s_acctbal + n_regionkey > (SELECT AVG(s_acctbal + n_regionkey) FROM supplier
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')""")
def above_average_query(t):
    homes = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"))
    there = homes.join(t.region, c("n_regionkey") == c("r_regionkey")).filter(c("r_name") != "ASIA")
    return above_average(homes, c("s_acctbal") + c("n_regionkey"), over=there).select("s_suppkey", "s_acctbal")


@query("self_join_hops", """
    SELECT a.role AS r0, b.role AS r1, m.role AS r2, e.role AS r3, COUNT(*) AS n
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    JOIN conversations m ON m.conv_id = b.conv_id AND m.turn = b.turn + 1
    JOIN conversations e ON e.conv_id = m.conv_id AND e.turn = m.turn + 1
    GROUP BY 1, 2, 3, 4""")
def self_join_hops(t):
    """Four copies of one table; (conversation, turn) is unique, so each hop
    keeps at most one row and a long conversation spreads over its turns."""
    turns = t.conversations.select("conv_id", "turn", "role")
    path = turns.withColumnRenamed("role", "r0")
    for hop in range(1, 4):
        following = turns.select("conv_id", (c("turn") - hop).alias("turn"), c("role").alias(f"r{hop}"))
        path = path.join(following, ["conv_id", "turn"])
    return path.groupBy("r0", "r1", "r2", "r3").agg(F.count(F.lit(1)).alias("n"))


@query("neighbour_hops", """
    WITH edge AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49 AND o_orderpriority = '1-URGENT')
    SELECT DISTINCT b AS nationkey FROM edge WHERE a IN (SELECT b FROM edge WHERE a IN (
      SELECT b FROM edge WHERE a IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')))""")
def neighbour_hops(t):
    """Neighbours of neighbours of neighbours over a distinct edge set."""
    urgent = t.orders.filter(c("o_orderpriority") == "1-URGENT")
    edge = (
        t.lineitem.filter("l_quantity >= 49").join(urgent, c("l_orderkey") == c("o_orderkey"))
        .join(t.customer, c("o_custkey") == c("c_custkey")).join(t.supplier, c("l_suppkey") == c("s_suppkey"))
        .select(c("c_nationkey").alias("a"), c("s_nationkey").alias("b")).distinct())
    reached = t.nation.filter(c("n_name") == "NATION_3").select(c("n_nationkey").alias("at"))
    for _ in range(3):
        reached = matching(edge, reached, "a", "at").select(c("b").alias("at"))
    return reached.select(c("at").alias("nationkey")).distinct()


@query("left_join_avg_of_counts", """
    SELECT ROUND(AVG(n), 6) AS avg_lines, COUNT(*) FILTER (WHERE n > 6) AS many FROM (
      SELECT o_orderkey, COUNT(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
      GROUP BY o_orderkey) s""")
def left_join_avg_of_counts(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"))
    counted = t.orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left").select(
        F.coalesce("n", F.lit(0)).alias("n"))
    return counted.agg(F.round(F.avg("n"), 6).alias("avg_lines"), count_where(c("n") > 6).alias("many"))


@query("global_aggs", """
    SELECT COUNT(*) AS n, COUNT(NULLIF(o_orderstatus, 'P')) AS not_p, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
           ROUND(AVG(o_totalprice), 4) AS mean, MIN(o_orderdate) AS first_day, MAX(o_totalprice) AS top,
           CAST(SUM(o_custkey) AS BIGINT) AS keys FROM orders""")
def global_aggs(t):
    return t.orders.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.nullif(c("o_orderstatus"), F.lit("P"))).alias("not_p"),
        F.sum(money("o_totalprice")).cast("double").alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
        F.min("o_orderdate").alias("first_day"), F.max("o_totalprice").alias("top"), F.sum("o_custkey").alias("keys"))


@query("count_distinct_mix", """
    SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers,
           MAX(DISTINCT l_quantity) AS top, MIN(DISTINCT l_tax) AS low, COUNT(*) AS n
    FROM lineitem GROUP BY l_returnflag""")
def count_distinct_mix(t):
    """One scan: Spark expands the rows per distinct column and first groups by
    (flag, value), so the work spreads over the values and not over the few flags."""
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.max("l_quantity").alias("top"), F.min("l_tax").alias("low"), F.count(F.lit(1)).alias("n"))


@query("cond_sum_diff", """
    SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
             - SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS diff,
           ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f_total
    FROM orders GROUP BY o_orderpriority""")
def cond_sum_diff(t):
    return t.orders.groupBy("o_orderpriority").agg(
        (sum_where(c("o_orderstatus") == "F") - sum_where(c("o_orderstatus") == "O")).alias("diff"),
        F.round(sum_where(c("o_orderstatus") == "F", c("o_totalprice")), 2).alias("f_total"))


@query("pct_ratio", """
    SELECT l_linestatus, ROUND(100.0 * SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / NULLIF(COUNT(*), 0), 2) AS pct,
           ROUND(CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE)
                 / NULLIF(CAST(SUM(CASE WHEN l_quantity > 50 THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS none
    FROM lineitem GROUP BY l_linestatus""")
def pct_ratio(t):
    return t.lineitem.groupBy("l_linestatus").agg(
        percent_where(c("l_returnflag") == "R").alias("pct"),
        F.round(safe_ratio(sum_where(c("l_quantity") > 25), sum_where(c("l_quantity") > 50)), 6).alias("none"))


@query("filter_count", """
    SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 250000) AS big,
           COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
    FROM orders GROUP BY o_orderstatus""")
def filter_count(t):
    return t.orders.groupBy("o_orderstatus").agg(
        count_where(c("o_totalprice") > 250000).alias("big"),
        count_where(c("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("yes_no", """
    SELECT CASE WHEN COUNT(*) > 0 THEN 'YES' ELSE 'NO' END AS answer FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate AND o_orderstatus = 'P'""")
def yes_no(t):
    """Any row will do: the count is partial on the executors."""
    early = t.lineitem.join(t.orders.filter(c("o_orderstatus") == "P"), c("l_orderkey") == c("o_orderkey")).filter(
        c("l_shipdate") < c("o_orderdate"))
    return early.agg(F.when(F.count(F.lit(1)) > 0, "YES").otherwise("NO").alias("answer"))


@query("having_variants", """
    WITH g AS (SELECT o_custkey, COUNT(*) AS n,
                 SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS ratio FROM orders GROUP BY o_custkey)
    SELECT o_custkey, n, CASE WHEN n = (SELECT MAX(n) FROM g) THEN 1 ELSE 0 END AS is_max FROM g
    WHERE (n > 12 AND ratio > 0.4) OR n = (SELECT MAX(n) FROM g)""")
def having_variants(t):
    g = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        safe_ratio(sum_where(c("o_orderstatus") == "F"), F.count(F.lit(1))).alias("ratio"))
    most = g.agg(F.max("n")).scalar()
    return g.filter(((c("n") > 12) & (c("ratio") > 0.4)) | (c("n") == most)).select(
        "o_custkey", "n", F.when(c("n") == most, 1).otherwise(0).alias("is_max"))


@query("group_by_expr", """
    SELECT SUBSTR(CAST(o_orderdate AS VARCHAR), 6, 2) AS month, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
    FROM orders GROUP BY SUBSTR(CAST(o_orderdate AS VARCHAR), 6, 2)""")
def group_by_expr(t):
    return t.orders.groupBy(F.substring(c("o_orderdate").cast("string"), 6, 2).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("group_dependent_order", """
    SELECT c_custkey, c_name, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
    GROUP BY c_custkey, c_name, c_acctbal ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def group_dependent_order(t):
    """The dependent column joins after grouping on the key alone."""
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        t.customer.join(counts, c("c_custkey") == c("o_custkey"))
        .orderBy(pg_desc("c_acctbal"), pg_asc("c_custkey")).limit(20).select("c_custkey", "c_name", "n"))


@query("avg_interval_seconds", """
    SELECT o_orderpriority, ROUND(AVG(EPOCH(l_shipdate - o_orderdate)), 4) AS avg_seconds,
           ROUND(AVG(EPOCH(l_shipdate - o_orderdate) / 60), 4) AS avg_minutes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def avg_interval_seconds(t):
    gap = seconds_between("o_orderdate", "l_shipdate")
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).groupBy("o_orderpriority").agg(
        F.round(F.avg(gap), 4).alias("avg_seconds"), F.round(F.avg(gap / 60), 4).alias("avg_minutes"))


@query("interval_text", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ROUND(value, 3) END AS seconds FROM events""")
def interval_text(t):
    """Lap times 'm:ss.ff' made from the value and read back; junk is null."""
    minutes = F.floor(c("value") / 60)
    text = F.format_string("%d:%05.2f", minutes, c("value") - minutes * 60)
    lap = F.when(c("event_type") == "error", "retired").otherwise(text)
    return t.events.select("event_id", F.round(lap_seconds(lap), 3).alias("seconds"))


@query("str_date_math", """
    SELECT o_orderkey, SUBSTR(o_orderpriority, 1, 7) AS head, RIGHT(o_orderpriority, 2) AS tail,
           STRFTIME(o_orderdate, '%Y') AS year, CAST(o_orderdate AS DATE) AS day,
           ABS(o_totalprice - 250000) AS dist, ROUND(o_totalprice / 7, 2) AS seventh,
           2001 - EXTRACT(YEAR FROM o_orderdate) AS age, TRY_CAST(SUBSTR(o_orderpriority, 1, 1) AS INTEGER) AS code,
           TRY_CAST(o_orderstatus AS INTEGER) AS bad, o_custkey // 7 AS q
    FROM orders""")
def str_date_math(t):
    last = F.lit("2001-08-01").cast("date")
    return t.orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 7).alias("head"), F.right("o_orderpriority", F.lit(2)).alias("tail"),
        year_text("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"),
        F.abs(c("o_totalprice") - 250000).alias("dist"), F.round(c("o_totalprice") / 7, 2).alias("seventh"),
        year_gap(last, "o_orderdate").cast("long").alias("age"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("code"),
        c("o_orderstatus").try_cast("int").alias("bad"), int_div("o_custkey", F.lit(7)).alias("q"))


@query("fixed_divisor_mean", """
    SELECT EXTRACT(YEAR FROM o_orderdate) AS year, ROUND(CAST(COUNT(*) AS DOUBLE) / 12, 6) AS monthly
    FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)""")
def fixed_divisor_mean(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        F.round(F.count(F.lit(1)).cast("double") / 12, 6).alias("monthly"))


@query("dense_rank_first", """
    SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, DENSE_RANK() OVER (ORDER BY p_size DESC) AS r FROM part) s
    WHERE r = 1""")
def dense_rank_first(t):
    return top_ranked(t.part, "p_size").select("p_partkey", "p_size")


@query("order_offset", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 6""")
def order_offset(t):
    return t.orders.orderBy(pg_desc("o_totalprice"), pg_asc("o_orderkey")).offset(6).limit(1).select(
        "o_orderkey", "o_totalprice")


@query("topk_nulls", """
    (SELECT 'desc' AS side, o_orderkey, first_ship FROM s ORDER BY first_ship DESC NULLS FIRST, o_orderkey LIMIT 300)
    UNION ALL
    (SELECT 'last' AS side, o_orderkey, first_ship FROM s ORDER BY first_ship ASC NULLS LAST, o_orderkey LIMIT 10)""".replace(
    " s ORDER", """ (SELECT o_orderkey, MIN(l_shipdate) AS first_ship FROM orders
      LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) s ORDER"""))
def topk_nulls(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    s = t.orders.join(first, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", "first_ship")
    high = s.orderBy(pg_desc("first_ship"), pg_asc("o_orderkey")).limit(300)
    low = s.orderBy(pg_asc("first_ship"), pg_asc("o_orderkey")).limit(10)
    return high.select(F.lit("desc").alias("side"), "*").unionByName(low.select(F.lit("last").alias("side"), "*"))


@query("limit_in_derived", """
    SELECT o_orderstatus, COUNT(*) AS n FROM (
      SELECT o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) s GROUP BY o_orderstatus""")
def limit_in_derived(t):
    top = t.orders.orderBy(pg_desc("o_totalprice"), pg_asc("o_orderkey")).limit(100)
    return top.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_order_limit", """
    SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_size DESC, p_brand LIMIT 15""")
def distinct_order_limit(t):
    return t.part.select("p_brand", "p_size").distinct().orderBy(pg_desc("p_size"), pg_asc("p_brand")).limit(15)


@query("order_by_expr", """
    SELECT c_custkey, c_name FROM customer ORDER BY ABS(c_acctbal - 5000), c_custkey LIMIT 10""")
def order_by_expr(t):
    return t.customer.orderBy(pg_asc(F.abs(c("c_acctbal") - 5000)), pg_asc("c_custkey")).limit(10).select(
        "c_custkey", "c_name")


@query("topk_by_distinct", """
    SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey
    ORDER BY parts DESC, l_suppkey LIMIT 5""")
def topk_by_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).orderBy(
        pg_desc("parts"), pg_asc("l_suppkey")).limit(5)


@query("union_minmax", """
    SELECT p_brand, v FROM (
      SELECT p_brand, MAX(p_retailprice) AS v FROM part GROUP BY p_brand
      UNION SELECT p_brand, MIN(p_retailprice) AS v FROM part GROUP BY p_brand) s
    ORDER BY v DESC, p_brand LIMIT 1""")
def union_minmax(t):
    both = t.part.groupBy("p_brand").agg(F.array(F.max("p_retailprice"), F.min("p_retailprice")).alias("vs"))
    return both.select("p_brand", F.explode("vs").alias("v")).distinct().orderBy(
        pg_desc("v"), pg_asc("p_brand")).limit(1)


@query("except_groups", """
    SELECT l_suppkey, l_returnflag FROM lineitem GROUP BY l_suppkey, l_returnflag HAVING COUNT(*) > 150
    EXCEPT SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity = 50 AND l_discount = 0 AND l_tax = 0""")
def except_groups(t):
    many = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).filter("n > 150")
    hit = t.lineitem.filter((c("l_quantity") == 50) & (c("l_discount") == 0) & (c("l_tax") == 0))
    return many.select("l_suppkey", "l_returnflag").subtract(hit.select("l_suppkey", "l_returnflag").distinct())


@query("distinct_multi", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def distinct_multi(t):
    return t.part.select("p_brand", "p_type", "p_size").distinct()


@query("star_select", """
    SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey""")
def star_select(t):
    return t.nation.alias("n").join(t.region, c("n_regionkey") == c("r_regionkey")).select("n.*", "r_name")


@query("full_sort", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def full_sort(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(pg_asc("o_orderdate"), pg_asc("o_orderkey"))


@query("limit_any", "SELECT COUNT(*) AS n FROM (SELECT * FROM orders LIMIT 10) s")
def limit_any(t):
    """Any ten rows; only their number is certain."""
    return t.orders.limit(10).agg(F.count(F.lit(1)).alias("n"))


@query("unique_names", """
    SELECT c_custkey AS c_custkey_0, c_name, c_custkey AS c_custkey_2, c_acctbal FROM customer""")
def unique_names_query(t):
    return with_unique_names(t.customer.select("c_custkey", "c_name", "c_custkey", "c_acctbal"))
