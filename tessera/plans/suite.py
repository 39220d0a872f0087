"""The 22 queries of the skewed decision-support benchmark, on the columns that the test tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import scan

c = F.col


def _revenue():
    return c("l_extendedprice") * (1 - c("l_discount"))


def _ts(day: str):
    return F.lit(day).cast("timestamp_ntz")


def _tables(spark: SparkSession, d: str, names: str) -> list[DataFrame]:
    return [scan(spark, d, n) for n in names.split()]


def _total(x, digits: int = 4):
    return F.round(F.sum(x), digits)


def q1(spark: SparkSession, d: str) -> DataFrame:
    (line,) = _tables(spark, d, "lineitem")
    charge = _revenue() * (1 + c("l_tax"))
    return (
        line.filter(c("l_shipdate") <= _ts("1998-09-21")).groupBy("l_returnflag", "l_linestatus")
        .agg(_total("l_quantity").alias("sum_qty"), _total("l_extendedprice").alias("sum_base_price"), _total(_revenue()).alias("sum_disc_price"), _total(charge, 3).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))
    )


def q2(spark: SparkSession, d: str) -> DataFrame:
    line, part, supplier, nation, region = _tables(spark, d, "lineitem part supplier nation region")
    near = supplier.join(nation, c("s_nationkey") == c("n_nationkey")).join(region.filter("r_name = 'MIDDLE EAST'"), c("n_regionkey") == c("r_regionkey"))
    offers = line.select("l_partkey", "l_suppkey", "l_extendedprice").join(part.filter("p_size = 15 AND p_type LIKE '%ARD'").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")).join(near.select("s_suppkey", "s_acctbal", "s_name", "n_name"), c("l_suppkey") == c("s_suppkey"))
    least = offers.groupBy(c("l_partkey").alias("k")).agg(F.min("l_extendedprice").alias("least"))
    return offers.join(least, (c("l_partkey") == c("k")) & (c("l_extendedprice") == c("least"))).select("p_partkey", "p_brand", "s_name", "s_acctbal", "n_name")


def q3(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = _tables(spark, d, "lineitem orders customer")
    buyers = customer.filter("c_mktsegment = 'HOUSEHOLD'").select("c_custkey")
    before = orders.filter(c("o_orderdate") < _ts("1998-05-31")).join(buyers, c("o_custkey") == c("c_custkey"), "left_semi")
    return line.filter(c("l_shipdate") > _ts("1998-05-31")).join(before, c("l_orderkey") == c("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(_total(_revenue()).alias("revenue"))


def q4(spark: SparkSession, d: str) -> DataFrame:
    line, orders = _tables(spark, d, "lineitem orders")
    quarter = orders.filter((c("o_orderdate") >= _ts("1996-05-01")) & (c("o_orderdate") < _ts("1996-08-01")))
    return quarter.join(line.filter("l_returnflag = 'R'"), c("l_orderkey") == c("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


def q4_fanout(spark: SparkSession, d: str) -> DataFrame:
    """The plan's variant: one count for each matching line."""
    line, orders = _tables(spark, d, "lineitem orders")
    quarter = orders.filter((c("o_orderdate") >= _ts("1996-05-01")) & (c("o_orderdate") < _ts("1996-08-01")))
    return quarter.join(line.filter("l_returnflag = 'R'"), c("l_orderkey") == c("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


def _year(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").filter((c("o_orderdate") >= _ts("1996-01-01")) & (c("o_orderdate") < _ts("1997-01-01")))


def q5(spark: SparkSession, d: str) -> DataFrame:
    line, customer, supplier, nation, region = _tables(spark, d, "lineitem customer supplier nation region")
    there = nation.join(region.filter("r_name = 'AMERICA'"), c("n_regionkey") == c("r_regionkey"))
    sellers = supplier.join(there, c("s_nationkey") == c("n_nationkey"))
    bought = _year(spark, d).join(customer, c("o_custkey") == c("c_custkey"))
    sold = line.join(sellers, c("l_suppkey") == c("s_suppkey"))
    return sold.join(bought, (c("l_orderkey") == c("o_orderkey")) & (c("c_nationkey") == c("s_nationkey"))).groupBy("n_name").agg(_total(_revenue()).alias("revenue"))


def q6(spark: SparkSession, d: str) -> DataFrame:
    (line,) = _tables(spark, d, "lineitem")
    year = (c("l_shipdate") >= _ts("1996-01-01")) & (c("l_shipdate") < _ts("1997-01-01"))
    return line.filter(year & c("l_discount").between(0.05, 0.07) & (c("l_quantity") < 24)).agg(_total(c("l_extendedprice") * c("l_discount")).alias("revenue"))


def q7(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer, supplier, nation = _tables(spark, d, "lineitem orders customer supplier nation")
    two = nation.filter(c("n_name").isin("NATION_3", "NATION_7"))
    sellers = supplier.join(two.select("n_nationkey", c("n_name").alias("supp_nation")), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "supp_nation")
    buyers = customer.join(two.select("n_nationkey", c("n_name").alias("cust_nation")), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "cust_nation")
    shipped = line.filter(c("l_shipdate").between(_ts("1996-01-01"), _ts("1997-12-31"))).join(sellers, c("l_suppkey") == c("s_suppkey"))
    traded = shipped.join(orders.join(buyers, c("o_custkey") == c("c_custkey")), c("l_orderkey") == c("o_orderkey")).filter("supp_nation != cust_nation")
    return traded.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("l_year")).agg(_total(_revenue()).alias("revenue"))


def q8(spark: SparkSession, d: str) -> DataFrame:
    line, part, orders, customer, supplier, nation, region = _tables(spark, d, "lineitem part orders customer supplier nation region")
    there = customer.join(nation.join(region.filter("r_name = 'AFRICA'"), c("n_regionkey") == c("r_regionkey")), c("c_nationkey") == c("n_nationkey")).select("c_custkey")
    bought = orders.filter(c("o_orderdate").between(_ts("1996-01-01"), _ts("1997-12-31"))).join(there, c("o_custkey") == c("c_custkey")).select("o_orderkey", F.year("o_orderdate").cast("long").alias("o_year"))
    sellers = supplier.join(nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")
    sold = line.join(part.filter("p_type = 'PROMO'"), c("l_partkey") == c("p_partkey")).join(sellers, c("l_suppkey") == c("s_suppkey")).join(bought, c("l_orderkey") == c("o_orderkey"))
    share = F.sum(F.when(c("n_name") == "NATION_3", _revenue()).otherwise(0.0)) / F.nullif(F.sum(_revenue()), F.lit(0.0))
    return sold.groupBy("o_year").agg(F.round(share, 4).alias("mkt_share"))


def q9(spark: SparkSession, d: str) -> DataFrame:
    line, part, orders, supplier, nation = _tables(spark, d, "lineitem part orders supplier nation")
    sellers = supplier.join(nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", c("n_name").alias("nation"))
    sold = line.join(part.filter("p_name LIKE '%widget%'"), c("l_partkey") == c("p_partkey")).join(sellers, c("l_suppkey") == c("s_suppkey")).join(orders, c("l_orderkey") == c("o_orderkey"))
    return sold.groupBy("nation", F.year("o_orderdate").cast("long").alias("o_year")).agg(_total(_revenue() - c("p_retailprice") * c("l_quantity")).alias("sum_profit"))


def q10(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer, nation = _tables(spark, d, "lineitem orders customer nation")
    month = orders.filter((c("o_orderdate") >= _ts("1996-05-01")) & (c("o_orderdate") < _ts("1996-06-01")))
    sold = line.filter("l_returnflag = 'R'").join(month, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey").agg(_total(_revenue()).alias("revenue"))
    return sold.join(customer, c("o_custkey") == c("c_custkey")).join(nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name")


def q11(spark: SparkSession, d: str) -> DataFrame:
    line, supplier, nation = _tables(spark, d, "lineitem supplier nation")
    own = supplier.join(nation.filter("n_name = 'NATION_3'"), c("s_nationkey") == c("n_nationkey"))
    parts = line.join(own, c("l_suppkey") == c("s_suppkey"), "left_semi").groupBy("l_partkey").agg(F.sum(c("l_extendedprice") * c("l_quantity")).alias("v"))
    total = parts.agg((F.sum("v") * 0.001).alias("least"))
    return parts.join(F.broadcast(total), c("v") > c("least")).select("l_partkey", F.round("v", 4).alias("value"))


def q12(spark: SparkSession, d: str) -> DataFrame:
    line, orders = _tables(spark, d, "lineitem orders")
    year = line.filter(c("l_returnflag").isin("A", "R") & (c("l_shipdate") >= _ts("1996-01-01")) & (c("l_shipdate") < _ts("1997-01-01")))
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    late = year.join(orders, (c("l_orderkey") == c("o_orderkey")) & (c("o_orderdate") < c("l_shipdate")))
    return late.groupBy("l_linestatus").agg(F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(~high, 1).otherwise(0)).alias("low_line_count"))


def _q13(spark: SparkSession, d: str, how: str) -> DataFrame:
    customer, orders = _tables(spark, d, "customer orders")
    some = orders.filter("o_orderpriority NOT LIKE '%URGENT%' AND o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return customer.join(some, c("c_custkey") == c("o_custkey"), how).groupBy(F.coalesce("n", F.lit(0)).cast("long").alias("c_count")).agg(F.count(F.lit(1)).alias("custdist"))


def q13(spark: SparkSession, d: str) -> DataFrame:
    return _q13(spark, d, "left")


def q13_inner(spark: SparkSession, d: str) -> DataFrame:
    """The plan's variant: customers without such orders are not counted."""
    return _q13(spark, d, "inner")


def q14(spark: SparkSession, d: str) -> DataFrame:
    line, part = _tables(spark, d, "lineitem part")
    month = line.filter((c("l_shipdate") >= _ts("1996-08-01")) & (c("l_shipdate") < _ts("1996-09-01"))).join(part, c("l_partkey") == c("p_partkey"))
    return month.agg(F.round(100.0 * F.sum(F.when(c("p_type").like("PROMO%"), _revenue()).otherwise(0.0)) / F.nullif(F.sum(_revenue()), F.lit(0.0)), 4).alias("promo_revenue"))


def q15(spark: SparkSession, d: str) -> DataFrame:
    line, supplier = _tables(spark, d, "lineitem supplier")
    quarter = line.filter((c("l_shipdate") >= _ts("1996-06-01")) & (c("l_shipdate") < _ts("1996-09-01")))
    revenue = quarter.groupBy("l_suppkey").agg(_total(_revenue()).alias("total_revenue"))
    best = revenue.agg(F.max("total_revenue").alias("best"))
    return revenue.join(F.broadcast(best), c("total_revenue") == c("best")).join(supplier, c("l_suppkey") == c("s_suppkey")).select("s_suppkey", "s_name", "total_revenue")


def q16(spark: SparkSession, d: str) -> DataFrame:
    line, part, supplier = _tables(spark, d, "lineitem part supplier")
    parts = part.filter((c("p_brand") != "Brand#11") & ~c("p_type").like("SMALL%") & c("p_size").isin(1, 2, 6, 7, 15, 22, 31, 37))
    some = line.select("l_partkey", "l_suppkey").join(parts, c("l_partkey") == c("p_partkey"))  # first, as it leaves few lines
    return some.join(supplier.filter("s_acctbal < 0"), c("l_suppkey") == c("s_suppkey"), "left_anti").select("p_brand", "p_type", "p_size", "l_suppkey").distinct().groupBy("p_brand", "p_type", "p_size").agg(F.count("l_suppkey").alias("supplier_cnt"))


def q17(spark: SparkSession, d: str) -> DataFrame:
    line, part = _tables(spark, d, "lineitem part")
    own = line.join(part.filter("p_brand = 'Brand#5'").select("p_partkey"), c("l_partkey") == c("p_partkey"))
    limit = own.groupBy(c("l_partkey").alias("k")).agg((F.avg("l_quantity") * 0.2).alias("few"))
    return own.join(limit, (c("l_partkey") == c("k")) & (c("l_quantity") < c("few"))).agg(F.round(F.sum("l_extendedprice") / 7.0, 4).alias("avg_yearly"))


def q18(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = _tables(spark, d, "lineitem orders customer")
    large = line.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).filter("sum_qty > 212")
    return large.join(orders, c("l_orderkey") == c("o_orderkey")).join(customer, c("o_custkey") == c("c_custkey")).select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty")


def q19(spark: SparkSession, d: str) -> DataFrame:
    line, part = _tables(spark, d, "lineitem part")
    branch = lambda brand, few, many, size: (c("p_brand") == brand) & c("l_quantity").between(few, many) & c("p_size").between(1, size)
    either = branch("Brand#1", 1, 11, 15) | branch("Brand#2", 10, 20, 30) | branch("Brand#3", 20, 30, 45)
    return line.filter(c("l_returnflag").isin("A", "R")).join(part, (c("l_partkey") == c("p_partkey")) & either).agg(_total(_revenue()).alias("revenue"))


def q20(spark: SparkSession, d: str) -> DataFrame:
    line, part, supplier, nation = _tables(spark, d, "lineitem part supplier nation")
    year = line.filter((c("l_shipdate") >= _ts("1996-01-01")) & (c("l_shipdate") < _ts("1997-01-01"))).join(part.filter("p_name LIKE 'small%'"), c("l_partkey") == c("p_partkey"), "left_semi")
    busy = year.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q")).filter("q > 60")
    five = nation.filter(c("n_name").isin("NATION_0", "NATION_1", "NATION_3", "NATION_7", "NATION_11"))
    return supplier.join(five, c("s_nationkey") == c("n_nationkey"), "left_semi").join(busy, c("s_suppkey") == c("l_suppkey"), "left_semi").select("s_name", "s_acctbal")


def q21(spark: SparkSession, d: str) -> DataFrame:
    line, orders, supplier, nation = _tables(spark, d, "lineitem orders supplier nation")
    sellers = supplier.join(nation.filter(c("n_name").isin("NATION_3", "NATION_7")), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "s_name")
    late = line.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    # two suppliers and one late supplier of an order: counts per order say both, without joining lines to lines
    per = line.groupBy(c("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min(F.when(c("l_returnflag") == "R", c("l_suppkey"))).alias("la"), F.max(F.when(c("l_returnflag") == "R", c("l_suppkey"))).alias("lb")).filter("a != b AND la = lb")
    return late.join(sellers, c("l_suppkey") == c("s_suppkey")).join(orders.filter("o_orderstatus = 'F'"), c("l_orderkey") == c("o_orderkey"), "left_semi").join(per, c("l_orderkey") == c("k"), "left_semi").groupBy("s_name").agg(F.count(F.lit(1)).alias("numwait"))


def q22(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = _tables(spark, d, "customer orders")
    own = customer.withColumn("code", F.substring("c_mktsegment", 1, 2)).filter(c("code").isin("AU", "BU", "HO"))
    mean = own.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = own.join(F.broadcast(mean), c("c_acctbal") > c("mean"))
    return rich.join(orders.filter(c("o_orderdate") >= _ts("2000-06-01")), c("c_custkey") == c("o_custkey"), "left_anti").groupBy(c("code").alias("cntrycode")).agg(F.count(F.lit(1)).alias("numcust"), _total("c_acctbal").alias("totacctbal"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q") and k[1:2].isdigit()}

#: Joins that the texts share.
_PAID = "l_extendedprice * (1 - l_discount)"
_LO = "lineitem JOIN orders ON o_orderkey = l_orderkey"
_LOC = f"{_LO} JOIN customer ON c_custkey = o_custkey"
_SN = "supplier JOIN nation ON n_nationkey = s_nationkey"
_IN = "TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59'"
_NEAR = f"(SELECT l.*, s_acctbal, s_name, n_name FROM lineitem l JOIN {_SN} ON s_suppkey = l_suppkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'MIDDLE EAST')"
SQL = {
    "q1": f"""WITH l AS (SELECT *, {_PAID} AS paid FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-21')
      SELECT l_returnflag, l_linestatus, count(*) AS count_order, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_quantity), 4) AS avg_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
      round(avg(l_extendedprice), 4) AS avg_price, round(sum(paid), 4) AS sum_disc_price, round(sum(paid * (1 + l_tax)), 3) AS sum_charge, round(avg(l_discount), 4) AS avg_disc FROM l GROUP BY ALL""",
    "q2": f"""WITH offers AS (SELECT * FROM {_NEAR} JOIN part ON p_partkey = l_partkey WHERE p_type LIKE '%ARD' AND p_size = 15)
      SELECT p_partkey, p_brand, s_name, s_acctbal, n_name FROM offers QUALIFY l_extendedprice = min(l_extendedprice) OVER (PARTITION BY p_partkey)""",
    "q3": f"""SELECT l_orderkey, o_orderdate, round(sum({_PAID}), 4) AS revenue FROM {_LOC} WHERE l_shipdate > TIMESTAMP '1998-05-31' AND c_mktsegment = 'HOUSEHOLD' AND o_orderdate < TIMESTAMP '1998-05-31' GROUP BY ALL""",
    "q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders SEMI JOIN (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON k = o_orderkey
      WHERE o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1996-08-01' GROUP BY ALL""",
    "q4_fanout": f"""SELECT o_orderpriority, count(*) AS order_count FROM {_LO} WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1996-08-01' GROUP BY ALL""",
    "q5": f"""SELECT n_name, round(sum({_PAID}), 4) AS revenue FROM {_LOC} JOIN {_SN} ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
      WHERE o_orderdate BETWEEN {_IN} AND r_name = 'AMERICA' GROUP BY ALL""",
    "q6": f"""SELECT round(sum(l_discount * l_extendedprice), 4) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_shipdate BETWEEN {_IN} AND l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE)""",
    "q7": f"""SELECT seller.n_name AS supp_nation, buyer.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum({_PAID}), 4) AS revenue FROM {_LOC} JOIN supplier ON s_suppkey = l_suppkey
      JOIN nation seller ON seller.n_nationkey = s_nationkey JOIN nation buyer ON buyer.n_nationkey = c_nationkey
      WHERE (seller.n_name, buyer.n_name) IN (('NATION_3', 'NATION_7'), ('NATION_7', 'NATION_3')) AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL""",
    "q8": f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(coalesce(sum({_PAID}) FILTER (WHERE seller.n_name = 'NATION_3'), 0) / sum({_PAID}), 4) AS mkt_share FROM {_LOC} JOIN part ON p_partkey = l_partkey
      JOIN supplier ON s_suppkey = l_suppkey JOIN nation seller ON seller.n_nationkey = s_nationkey JOIN nation buyer ON buyer.n_nationkey = c_nationkey JOIN region ON r_regionkey = buyer.n_regionkey
      WHERE p_type = 'PROMO' AND r_name = 'AFRICA' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL""",
    "q9": f"""SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum({_PAID} - l_quantity * p_retailprice), 4) AS sum_profit FROM {_LO} JOIN {_SN} ON s_suppkey = l_suppkey
      JOIN part ON p_partkey = l_partkey WHERE contains(p_name, 'widget') GROUP BY ALL""",
    "q10": f"""SELECT c_custkey, c_name, c_acctbal, n_name, round(sum({_PAID}), 4) AS revenue FROM {_LOC} JOIN nation ON n_nationkey = c_nationkey
      WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1996-06-01' GROUP BY ALL""",
    "q11": f"""WITH v AS (SELECT l_partkey, sum(l_quantity * l_extendedprice) AS v FROM lineitem JOIN {_SN} ON s_suppkey = l_suppkey WHERE n_name = 'NATION_3' GROUP BY ALL)
      SELECT l_partkey, round(v, 4) AS value FROM v WHERE v > (SELECT sum(v) * CAST(0.001 AS DOUBLE) FROM v)""",
    "q12": f"""SELECT l_linestatus, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
      FROM {_LO} WHERE l_shipdate BETWEEN {_IN} AND o_orderdate < l_shipdate AND l_returnflag IN ('A', 'R') GROUP BY ALL""",
    "q13": """WITH n AS (SELECT count(o.o_custkey) AS c_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '%URGENT%') o ON o.o_custkey = c_custkey GROUP BY c_custkey)
      SELECT c_count, count(*) AS custdist FROM n GROUP BY ALL""",
    "q13_inner": """WITH n AS (SELECT count(*) AS c_count FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '%URGENT%' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey)
      SELECT c_count, count(*) AS custdist FROM n GROUP BY ALL""",
    "q14": f"""SELECT round(100 * sum({_PAID}) FILTER (WHERE starts_with(p_type, 'PROMO')) / sum({_PAID}), 4) AS promo_revenue FROM part JOIN lineitem ON l_partkey = p_partkey
      WHERE l_shipdate >= TIMESTAMP '1996-08-01' AND l_shipdate < TIMESTAMP '1996-09-01'""",
    "q15": f"""WITH r AS (SELECT l_suppkey AS s_suppkey, round(sum({_PAID}), 4) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-01' AND l_shipdate < TIMESTAMP '1996-09-01' GROUP BY ALL)
      SELECT s_suppkey, s_name, total_revenue FROM r JOIN supplier USING (s_suppkey) QUALIFY total_revenue = max(total_revenue) OVER ()""",
    "q16": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM part JOIN lineitem ON l_partkey = p_partkey ANTI JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) ON s_suppkey = l_suppkey
      WHERE p_size IN (1, 2, 6, 7, 15, 22, 31, 37) AND NOT starts_with(p_type, 'SMALL') AND p_brand != 'Brand#11' GROUP BY ALL""",
    "q17": """WITH l AS (SELECT l_extendedprice, l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#5')
      SELECT round(sum(l_extendedprice) / 7, 4) AS avg_yearly FROM l WHERE l_quantity < CAST(0.2 AS DOUBLE) * mean""",
    "q18": f"""SELECT c_custkey, c_name, o_orderkey, o_totalprice, o_orderdate, sum(l_quantity) AS sum_qty FROM {_LOC} GROUP BY ALL HAVING sum(l_quantity) > 212""",
    "q19": f"""SELECT round(sum({_PAID}), 4) AS revenue FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A') AND p_size >= 1 AND CASE p_brand
      WHEN 'Brand#1' THEN l_quantity BETWEEN 1 AND 11 AND p_size <= 15 WHEN 'Brand#2' THEN l_quantity BETWEEN 10 AND 20 AND p_size <= 30 WHEN 'Brand#3' THEN l_quantity BETWEEN 20 AND 30 AND p_size <= 45 ELSE false END""",
    "q20": f"""WITH busy AS (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE starts_with(p_name, 'small') AND l_shipdate BETWEEN {_IN} GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 60)
      SELECT s_name, s_acctbal FROM {_SN} WHERE s_suppkey IN (FROM busy) AND n_name IN ('NATION_11', 'NATION_7', 'NATION_3', 'NATION_1', 'NATION_0')""",
    "q21": f"""SELECT s_name, count(*) AS numwait FROM {_LO} JOIN {_SN} ON s_suppkey = l_suppkey WHERE n_name IN ('NATION_3', 'NATION_7') AND l_returnflag = 'R' AND o_orderstatus = 'F'
      AND EXISTS (FROM lineitem other WHERE other.l_orderkey = o_orderkey AND other.l_suppkey != s_suppkey) AND NOT EXISTS (FROM lineitem late WHERE late.l_returnflag = 'R' AND late.l_orderkey = o_orderkey AND late.l_suppkey != s_suppkey) GROUP BY ALL""",
    "q22": """WITH own AS (SELECT *, left(c_mktsegment, 2) AS cntrycode FROM customer WHERE left(c_mktsegment, 2) IN ('AU', 'BU', 'HO'))
      SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM own ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01') ON o_custkey = c_custkey
      WHERE c_acctbal > (SELECT avg(c_acctbal) FILTER (WHERE c_acctbal > 0) FROM own) GROUP BY ALL""",
}
