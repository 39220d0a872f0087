"""One query for each operator of the inventory, built with the library's own operators, and its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import aggregates, graph, joins, profile, skew
from ..operators.relation import Rel
from ..sources import catalog

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the session's executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}" if where else "file://" + tempfile.mkdtemp(prefix=f"{name}-")


# scans, sources, sinks


@_add("scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _scan(spark, d):
    return Rel.scan(spark, d, "nation", "n1").project("n1.n_nationkey", "n1.n_name", "n1.n_regionkey").result()


@_add("temp_table", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY ALL")
def _temp(spark, d):
    Rel.scan(spark, d, "nation").where(c("n_nationkey") > 3).create_temp("some_nations")
    return Rel.temp(spark, "some_nations", "t").aggregate(["n_regionkey"], [("count", None, "n")]).result()


@_add("index_scan", "SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def _index_scan(spark, d):
    some = Rel.scan(spark, d, "customer").where(c("c_mktsegment") == "BUILDING")
    return some.along(catalog.TPCH.relationship("customer", ("c_custkey",), "orders"), Rel.scan(spark, d, "orders")).project("c_custkey", "o_orderkey").result()


_SUPPLIER = catalog.Table("supplier", {"s_suppkey": "long", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"})


@_add("tbl_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _tbl(spark, d):
    path = _folder(spark, "tbl")
    catalog.write_tbl(catalog.scan(spark, d, "supplier").select(*_SUPPLIER.columns), path)
    return catalog.read_tbl(spark, path, _SUPPLIER)


@_add("date_parse", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")
def _date(spark, d):
    text = catalog.scan(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("t")).distinct()
    return text.select(catalog.as_date(c("t")).alias("day"))


@_add("column_store", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100")
def _columns(spark, d):
    path = _folder(spark, "columns")
    catalog.write_result(catalog.scan(spark, d, "customer"), path)
    return spark.read.parquet(path).select("c_custkey", "c_acctbal").filter("c_acctbal > 100")


@_add("csv_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _csv(spark, d):
    path = _folder(spark, "csv")
    nation = catalog.scan(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    catalog.write_result(nation, path, "csv")
    return spark.read.schema(nation.schema).option("header", True).csv(path)


@_add("fan_out_histogram", """SELECT n_targets, count(*) AS n_rows FROM (SELECT o_orderkey, count(l_orderkey) AS n_targets FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) GROUP BY ALL""")
def _fan_out(spark, d):
    return catalog.fan_out(catalog.scan(spark, d, "orders"), catalog.scan(spark, d, "lineitem"), catalog.TPCH.relationship("orders", ("o_orderkey",), "lineitem"))


_KEYS = """('nation', 'n_regionkey', 'region', 'r_regionkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'),
  ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey'),
  ('lineitem', 'l_partkey,l_suppkey', 'partsupp', 'ps_partkey,ps_suppkey'), ('partsupp', 'ps_partkey', 'part', 'p_partkey'), ('partsupp', 'ps_suppkey', 'supplier', 's_suppkey')"""


@_add("catalog_keys", f"""WITH k(a, x, b, y) AS (VALUES {_KEYS}) SELECT a AS source, x AS columns, b AS target, y AS keys, true AS is_unique FROM k UNION ALL SELECT b, y, a, x, false FROM k""")
def _catalog(spark, d):
    """The relationships of a catalog that was saved and loaded again."""
    path = _folder(spark, "catalog")
    spark.createDataFrame([(catalog.TPCH.to_json(),)], "text string").write.text(path)
    loaded = catalog.Catalog.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small document
    rows = [(t.name, ",".join(r.source), r.target, ",".join(r.keys), r.unique) for t in loaded.tables.values() for r in t.relationships]
    return spark.createDataFrame(rows, "source string, columns string, target string, keys string, is_unique boolean")


@_add("bucketed_join", "SELECT o_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _bucketed(spark, d):
    """Two tables bucketed by the key that joins them: neither the join nor the grouping shuffles."""
    name = uuid.uuid4().hex
    orders, line = catalog.scan(spark, d, "orders").select("o_orderkey"), catalog.scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    buckets = catalog.buckets_for(orders, line)
    orders = catalog.write_bucketed(orders, f"orders_{name}", ["o_orderkey"], buckets, _folder(spark, "bucketed"))
    line = catalog.write_bucketed(line, f"lineitem_{name}", ["l_orderkey"], buckets, _folder(spark, "bucketed"))
    return Rel(orders).join(Rel(line), [("l_orderkey", "o_orderkey")]).aggregate(["o_orderkey"], [("count", None, "n"), ("sum", "l_linenumber", "s")]).result()


# projections and filters


@_add("projection", "SELECT o_orderstatus, o_orderpriority FROM orders")
def _projection(spark, d):
    return Rel.scan(spark, d, "orders").project("o_orderstatus", "o_orderpriority").result()


@_add("map", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem")
def _map(spark, d):
    return Rel.scan(spark, d, "lineitem").map("twice", s.mul(c("l_quantity"), F.lit(2.0))).project("l_orderkey", "l_linenumber", "twice").result()


@_add("multimap", "SELECT c_custkey, -c_acctbal AS c_acctbal, c_acctbal + 1 AS more FROM customer")
def _multimap(spark, d):
    return Rel.scan(spark, d, "customer").multimap({"c_acctbal": -c("c_acctbal"), "more": c("c_acctbal") + 1}).project("c_custkey", "c_acctbal", "more").result()


@_add("selection", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 3 AND l_discount >= 0.05")
def _selection(spark, d):
    return Rel.scan(spark, d, "lineitem").where((c("l_quantity") < 3) & (c("l_discount") >= 0.05)).project("l_orderkey", "l_partkey").result()


@_add("selection_constant", "SELECT r_name FROM region WHERE 1 > 0")
def _constant(spark, d):
    return Rel.scan(spark, d, "region").where(s.larger(s.const(1), s.const(0))).project("r_name").result()


# joins


@_add("join_inner", "SELECT o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey")
def _inner(spark, d):
    return Rel.scan(spark, d, "orders").join(Rel.scan(spark, d, "customer"), [("c_custkey", "o_custkey")]).project("o_orderkey", "c_name").result()


@_add("join_residual", "SELECT l_orderkey, l_linenumber, p_partkey FROM part JOIN lineitem ON p_partkey = l_partkey AND l_extendedprice > p_retailprice * 10")
def _residual(spark, d):
    line, part = Rel.scan(spark, d, "lineitem"), Rel.scan(spark, d, "part")
    return line.join(part, [("p_partkey", "l_partkey")], c("l_extendedprice") > c("p_retailprice") * 10).project("l_orderkey", "l_linenumber", "p_partkey").result()


@_add("join_unique", """SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) AS n FROM lineitem) ON o_orderkey = l_orderkey WHERE n = 1""")
def _unique(spark, d):
    line = Rel.scan(spark, d, "lineitem").project("l_orderkey", "l_partkey", "l_quantity")
    return Rel.scan(spark, d, "orders").unique_join(line, [("l_orderkey", "o_orderkey")]).project("o_orderkey", "l_partkey", "l_quantity").result()


@_add("join_multimatch", "SELECT c_custkey, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal")
def _multimatch(spark, d):
    return Rel.scan(spark, d, "customer").join(Rel.scan(spark, d, "orders"), [("o_custkey", "c_custkey")], c("o_totalprice") > c("c_acctbal")).project("c_custkey", "o_orderkey", "o_totalprice").result()


@_add("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def _semi(spark, d):
    return Rel.scan(spark, d, "orders").semi(Rel.scan(spark, d, "lineitem"), [("l_orderkey", "o_orderkey")], c("l_quantity") > 45).project("o_orderkey").result()


@_add("join_semi_residual", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem a WHERE EXISTS (SELECT * FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")
def _semi_residual(spark, d):
    a, b = Rel.scan(spark, d, "lineitem", "a"), Rel.scan(spark, d, "lineitem", "b")
    return a.semi(b, [("b.l_orderkey", "a.l_orderkey")], c("b.l_suppkey") != c("a.l_suppkey")).project("a.l_orderkey", "a.l_linenumber", "a.l_suppkey").result()


@_add("join_anti_residual", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT * FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_returnflag = 'R')")
def _anti_residual(spark, d):
    a, b = (Rel.scan(spark, d, "lineitem", x).where(c("l_returnflag") == "R") for x in "ab")
    return a.anti(b, [("b.l_orderkey", "a.l_orderkey")], c("b.l_suppkey") != c("a.l_suppkey")).project("a.l_orderkey", "a.l_linenumber", "a.l_suppkey").result()


@_add("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5)")
def _anti(spark, d):
    return Rel.scan(spark, d, "orders").anti(Rel.scan(spark, d, "lineitem"), [("l_orderkey", "o_orderkey")], c("l_quantity") > 5).project("o_orderkey").result()


@_add("join_outer", "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'")
def _outer(spark, d):
    return Rel.scan(spark, d, "orders").outer(Rel.scan(spark, d, "lineitem"), [("l_orderkey", "o_orderkey")], c("l_returnflag") == "R").project("o_orderkey", "l_partkey").result()


@_add("join_theta", "SELECT n1.n_nationkey AS a, n2.n_nationkey AS b FROM nation n1, nation n2 WHERE n1.n_nationkey < n2.n_nationkey AND n1.n_regionkey = 0")
def _theta(spark, d):
    a, b = Rel.scan(spark, d, "nation", "n1"), Rel.scan(spark, d, "nation", "n2")
    return a.theta(b, (c("n1.n_nationkey") < c("n2.n_nationkey")) & (c("n1.n_regionkey") == 0)).project(c("n1.n_nationkey").alias("a"), c("n2.n_nationkey").alias("b")).result()


@_add("join_scalar", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
def _scalar(spark, d):
    supplier = Rel.scan(spark, d, "supplier")
    return supplier.with_scalar(supplier.aggregate([], [("avg", "s_acctbal", "mean")])).where(c("s_acctbal") > c("mean")).project("s_suppkey", "s_acctbal").result()


@_add("join_along", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _along(spark, d):
    return Rel.scan(spark, d, "lineitem").along(catalog.TPCH.relationship("lineitem", ("l_orderkey",), "orders"), Rel.scan(spark, d, "orders")).project("l_orderkey", "l_linenumber", "o_custkey").result()


@_add("join_along_fanout", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def _along_many(spark, d):
    return Rel.scan(spark, d, "region").along(catalog.TPCH.relationship("region", ("r_regionkey",), "nation"), Rel.scan(spark, d, "nation")).project("r_name", "n_name").result()


@_add("join_composite", """SELECT a.l_orderkey, b.n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE b.n > 1""")
def _composite(spark, d):
    pairs = Rel.scan(spark, d, "lineitem").aggregate(["l_partkey", "l_suppkey"], [("count", None, "n")]).where(c("n") > 1).project(c("l_partkey").alias("ps_partkey"), c("l_suppkey").alias("ps_suppkey"), "n")
    return Rel.scan(spark, d, "lineitem").along(catalog.TPCH.relationship("lineitem", ("l_partkey", "l_suppkey"), "partsupp"), pairs).project("l_orderkey", "n").result()


@_add("join_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def _not_in(spark, d):
    return joins.not_in(catalog.scan(spark, d, "lineitem").filter("l_quantity > 40"), catalog.scan(spark, d, "part"), "l_partkey", "p_partkey").select("p_partkey")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Users of consecutive events, from the lesser to the greater: vertices and edges grow with the table."""
    events = spark.read.parquet(f"{d}/events.parquet")
    pairs = events.select(c("event_id").alias("i"), c("user_id").alias("u")).join(events.select((c("event_id") - 1).alias("i"), c("user_id").alias("v")), "i").filter("u != v")
    return pairs.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


_E = "WITH e AS (SELECT DISTINCT least(a.user_id, b.user_id) AS src, greatest(a.user_id, b.user_id) AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id)"


@_add("graph_exist", f"{_E} SELECT a.src AS a, a.dst AS b, b.dst AS c FROM e a JOIN e b ON a.dst = b.src WHERE EXISTS (SELECT * FROM e WHERE e.src = a.src AND e.dst = b.dst)")
def _exist(spark, d):
    e = _edges(spark, d)
    paths = e.select(c("src").alias("a"), c("dst").alias("b")).join(e.select(c("src").alias("b"), c("dst").alias("c")), "b").select("a", "b", "c")
    return graph.exists(paths, e, "c", ["a"])


@_add("graph_extend", f"{_E} SELECT a.src AS a, a.dst AS b, b.dst AS c FROM e a JOIN e b ON a.dst = b.src JOIN e x ON x.src = a.src AND x.dst = b.dst")
def _extend(spark, d):
    return graph.triangles(_edges(spark, d))


@_add("trie_scan", "SELECT DISTINCT c_nationkey AS nation FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey")
def _trie(spark, d):
    return graph.variable("nation", (catalog.scan(spark, d, "customer"), "c_nationkey"), (catalog.scan(spark, d, "supplier"), "s_nationkey"), (catalog.scan(spark, d, "nation"), "n_nationkey"))


@_add("trie_intersection", """SELECT DISTINCT n.n_nationkey AS nation, l.l_suppkey AS supp FROM nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey WHERE l.l_returnflag = 'R'""")
def _intersection(spark, d):
    nation = catalog.scan(spark, d, "nation").select(c("n_nationkey").alias("nation"))
    supplier = catalog.scan(spark, d, "supplier").select(c("s_nationkey").alias("nation"), "s_suppkey")
    line = catalog.scan(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey")
    return graph.intersection(nation, "supp", [(supplier, ["nation"], "s_suppkey"), (line, [], "l_suppkey")]).select("nation", "supp")


@_add("multiway_join", """SELECT o_custkey AS cust, o_orderkey AS ord, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7""")
def _multiway(spark, d):
    orders = catalog.scan(spark, d, "orders").select(c("o_custkey").alias("cust"), c("o_orderkey").alias("ord"))
    line = catalog.scan(spark, d, "lineitem").select(c("l_orderkey").alias("ord"), c("l_partkey").alias("part"))
    part = catalog.scan(spark, d, "part").filter("p_size = 7").select(c("p_partkey").alias("part"))
    return graph.multiway([part, line, orders]).select("cust", "ord", "part")


# aggregates


@_add("aggregate_grouped", """SELECT l_returnflag, round(sum(l_quantity), 4) AS s, count(*) AS n, round(avg(l_quantity), 4) AS a, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY ALL""")
def _grouped(spark, d):
    out = Rel.scan(spark, d, "lineitem").aggregate(["l_returnflag"], [("sum", "l_quantity", "s"), ("count", None, "n"), ("avg", "l_quantity", "a"), ("min", "l_quantity", "low"), ("max", "l_quantity", "high")])
    return out.multimap({"s": F.round("s", 4), "a": F.round("a", 4)}).result()


@_add("aggregate_global", "SELECT round(sum(o_totalprice), 3) AS s, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def _global(spark, d):
    return Rel.scan(spark, d, "orders").aggregate([], [("sum", "o_totalprice", "s"), ("count", None, "n"), ("min", "o_totalprice", "low"), ("max", "o_totalprice", "high")]).map("s", F.round("s", 3)).result()


@_add("aggregate_global_empty", "SELECT sum(o_totalprice) AS s, count(*) AS n, min(o_totalprice) AS low FROM orders WHERE o_orderkey < 0")
def _global_empty(spark, d):
    return Rel.scan(spark, d, "orders").where(c("o_orderkey") < 0).aggregate([], [("sum", "o_totalprice", "s"), ("count", None, "n"), ("min", "o_totalprice", "low")]).result()


@_add("aggregate_sum", "SELECT o_custkey, round(sum(o_totalprice), 4) AS s FROM orders GROUP BY ALL")
def _sum(spark, d):
    return Rel.scan(spark, d, "orders").aggregate(["o_custkey"], [("sum", "o_totalprice", "s")]).map("s", F.round("s", 4)).result()


@_add("aggregate_count", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _count(spark, d):
    return Rel.scan(spark, d, "orders").outer(Rel.scan(spark, d, "lineitem"), [("l_orderkey", "o_orderkey")]).aggregate(["o_orderkey"], [("count", "l_orderkey", "n")]).result()


@_add("aggregate_avg", "SELECT p_brand, round(avg(p_retailprice), 4) AS a FROM part GROUP BY ALL")
def _avg(spark, d):
    return Rel.scan(spark, d, "part").aggregate(["p_brand"], [("avg", "p_retailprice", "a")]).map("a", F.round("a", 4)).result()


@_add("aggregate_min", "SELECT l_partkey, min(l_extendedprice) AS low FROM lineitem GROUP BY ALL")
def _min(spark, d):
    return Rel.scan(spark, d, "lineitem").aggregate(["l_partkey"], [("min", "l_extendedprice", "low")]).result()


@_add("aggregate_max_negative", "SELECT c_nationkey, max(-abs(c_acctbal) - 1) AS high FROM customer GROUP BY ALL")
def _max(spark, d):
    return Rel.scan(spark, d, "customer").map("v", -s.absolute(c("c_acctbal")) - 1).aggregate(["c_nationkey"], [("max", "v", "high")]).result()


@_add("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL")
def _distinct(spark, d):
    return aggregates.count_distinct(catalog.scan(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "n")


@_add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 12")
def _having(spark, d):
    return Rel.scan(spark, d, "orders").aggregate(["o_custkey"], [("count", None, "n")]).where(c("n") > 12).result()


@_add("group_by_key", "SELECT p_partkey, avg(l_quantity) AS q FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand = 'Brand#5' GROUP BY p_partkey")
def _by_key(spark, d):
    return Rel.scan(spark, d, "lineitem").join(Rel.scan(spark, d, "part").where(c("p_brand") == "Brand#5"), [("p_partkey", "l_partkey")]).aggregate(["p_partkey"], [("avg", "l_quantity", "q")]).result()


@_add("aggregate_two_phase", "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL")
def _two_phase(spark, d):
    out = skew.two_phase(catalog.scan(spark, d, "lineitem"), ["l_linestatus"], [("count", None, "n"), ("sum", "l_quantity", "s"), ("avg", "l_quantity", "a"), ("min", "l_tax", "low"), ("max", "l_tax", "high")])
    return out.withColumns({"s": F.round("s", 4), "a": F.round("a", 4)})


# skew


def _hot_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which a third have one part."""
    return catalog.scan(spark, d, "lineitem").select("l_orderkey", F.when(c("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(c("l_partkey")).alias("k"), "l_quantity")


_H = "(SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS k, l_quantity FROM lineitem)"


@_add("skew_hot_keys", f"SELECT k, n FROM (SELECT k, count(*) AS n FROM {_H} GROUP BY k) WHERE n > (SELECT count(*) FROM lineitem) * 0.01")
def _hot(spark, d):
    return skew.hot_keys(_hot_lines(spark, d), ["k"])


for _how, _text in (
    ("inner", f"SELECT l_orderkey, k, p_size FROM {_H} JOIN part ON p_partkey = k WHERE p_size < 9"),
    ("left", f"SELECT l_orderkey, k, p_size FROM {_H} LEFT JOIN (SELECT * FROM part WHERE p_size < 9) ON p_partkey = k"),
    ("left_semi", f"SELECT l_orderkey, k FROM {_H} WHERE k IN (SELECT p_partkey FROM part WHERE p_size < 9)"),
    ("left_anti", f"SELECT l_orderkey, k FROM {_H} WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size < 9)"),
):

    @_add(f"skew_salted_{_how}", _text)
    def _salted(spark, d, how=_how):
        part = catalog.scan(spark, d, "part").filter("p_size < 9").select(c("p_partkey").alias("k"), "p_size")
        out = skew.salted_join(_hot_lines(spark, d), part, ["k"], how)
        return out.select("l_orderkey", "k", *(["p_size"] if how in ("inner", "left") else []))


# scalar expressions, each over a table


def _scalar_query(name: str, table: str, keys: str, value: Column | Callable[[], Column], sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Rel.scan(spark, d, table).map("v", value()).project(*keys.split(), "v").result()

    _add(f"expr_{name}", f"SELECT {keys.replace(' ', ', ')}, {sql} AS v FROM {table}")(query)


for _name, _table, _keys, _value, _sql in (
    ("attr", "part", "p_partkey", lambda: s.attr("part.p_size"), "p_size"),
    ("const", "region", "r_name", lambda: s.const("1.5f", "double"), "CAST(1.5 AS DOUBLE)"),
    ("const_date", "region", "r_name", lambda: s.const("19960630", "date"), "DATE '1996-06-30'"),
    ("equals", "orders", "o_orderkey", lambda: s.equals(c("o_orderstatus"), s.const("F")), "o_orderstatus = 'F'"),
    ("smaller", "part", "p_partkey", lambda: s.smaller(c("p_size"), s.const(9)), "p_size < 9"),
    ("smaller_equal", "part", "p_partkey", lambda: s.smaller_equal(c("p_size"), s.const(9)), "p_size <= 9"),
    ("larger", "part", "p_partkey", lambda: s.larger(c("p_size"), s.const(9)), "p_size > 9"),
    ("larger_equal", "part", "p_partkey", lambda: s.larger_equal(c("p_size"), s.const(9)), "p_size >= 9"),
    ("and", "part", "p_partkey", lambda: s.all_of(c("p_size") > 9, c("p_size") < 20), "p_size > 9 AND p_size < 20"),
    ("or", "part", "p_partkey", lambda: s.any_of(c("p_size") < 9, c("p_size") > 20), "p_size < 9 OR p_size > 20"),
    ("not", "part", "p_partkey", lambda: s.negate(c("p_type") == "PROMO"), "NOT p_type = 'PROMO'"),
    ("in", "part", "p_partkey", lambda: s.is_in(c("p_size"), [1, 5, 9]), "p_size IN (1, 5, 9)"),
    ("like", "part", "p_partkey", lambda: s.like(c("p_name"), "%l w_dg%"), "p_name LIKE '%l w_dg%'"),
    ("substring", "customer", "c_custkey", lambda: s.substring(c("c_name"), 3, 5), "substring(c_name, 3, 5)"),
    ("substring_before", "customer", "c_custkey", lambda: s.substring(c("c_name"), 0, 2), "substring(c_name, 0, 2)"),
    ("case", "part", "p_partkey", lambda: s.case([(c("p_size") < 9, s.const(1.0)), (c("p_size") < 20, s.const(2.0))], s.const(3.0)), "CASE WHEN p_size < 9 THEN CAST(1 AS DOUBLE) WHEN p_size < 20 THEN 2 ELSE 3 END"),
    ("case_no_else", "part", "p_partkey", lambda: s.case([(c("p_size") < 9, s.const(1.0))]), "CASE WHEN p_size < 9 THEN CAST(1 AS DOUBLE) END"),
    ("mul", "lineitem", "l_orderkey l_partkey", lambda: s.mul(c("l_quantity"), c("l_extendedprice")), "l_quantity * l_extendedprice"),
    ("add", "lineitem", "l_orderkey l_partkey", lambda: s.add(c("l_tax"), c("l_discount")), "l_tax + l_discount"),
    ("sub", "lineitem", "l_orderkey l_partkey", lambda: s.sub(c("l_tax"), c("l_discount")), "l_tax - l_discount"),
    ("div", "lineitem", "l_orderkey l_partkey", lambda: s.div(c("l_extendedprice"), c("l_quantity")), "l_extendedprice / l_quantity"),
    ("div_zero", "lineitem", "l_orderkey l_partkey", lambda: s.div(c("l_tax"), c("l_quantity") - 1), "CASE WHEN l_quantity <> 1 THEN l_tax / (l_quantity - 1) END"),
    ("abs", "customer", "c_custkey", lambda: s.absolute(c("c_acctbal")), "abs(c_acctbal)"),
    ("product", "lineitem", "l_orderkey l_partkey", lambda: s.product(c("l_quantity"), c("l_tax"), c("l_discount")), "l_quantity * l_tax * l_discount"),
    ("touch", "region", "r_name", lambda: s.touch(c("r_regionkey"), c("r_name")), "1"),
    ("extract_day", "orders", "o_orderkey", lambda: s.extract("day", c("o_orderdate")), "CAST(day(o_orderdate) AS BIGINT)"),
    ("extract_month", "orders", "o_orderkey", lambda: s.extract("month", c("o_orderdate")), "CAST(month(o_orderdate) AS BIGINT)"),
    ("extract_year", "orders", "o_orderkey", lambda: s.extract("year", c("o_orderdate")), "CAST(year(o_orderdate) AS BIGINT)"),
    ("power_loop", "part", "p_partkey", lambda: s.power_loop(c("p_size").cast("double"), 3), "CAST(p_size AS DOUBLE) * p_size * p_size"),
):
    _scalar_query(_name, _table, _keys, _value, _sql)


# subquery shapes that the suite doesn't hold by themselves


@_add("subquery_correlated_min", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem a WHERE l_extendedprice = (SELECT min(l_extendedprice) FROM lineitem b WHERE a.l_partkey = b.l_partkey)")
def _correlated(spark, d):
    line = Rel.scan(spark, d, "lineitem")
    least = line.aggregate([c("l_partkey").alias("k")], [("min", "l_extendedprice", "least")])
    return line.join(least, [("k", "l_partkey"), ("least", "l_extendedprice")]).project("l_orderkey", "l_partkey", "l_extendedprice").result()


@_add("subquery_in_having", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)")
def _in_having(spark, d):
    large = Rel.scan(spark, d, "lineitem").aggregate(["l_orderkey"], [("sum", "l_quantity", "q")]).where(c("q") > 200)
    return Rel.scan(spark, d, "orders").semi(large, [("l_orderkey", "o_orderkey")]).project("o_orderkey").result()


# profiles


@_add("profile_keys", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) AS largest, max(n) * count(*) / sum(n) AS imbalance FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)")
def _profile_keys(spark, d):
    return profile.key_imbalance(catalog.scan(spark, d, "orders"), ["o_custkey"])


@_add("profile_partitions", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest, max(n) * 8 / sum(n) AS imbalance FROM (SELECT l_partkey % 8 AS p, count(*) AS n FROM lineitem GROUP BY ALL)")
def _profile_partitions(spark, d):
    return profile.imbalance(catalog.scan(spark, d, "lineitem").repartitionById(8, F.pmod("l_partkey", F.lit(8)).cast("int")), 8)


@_add("profile_event_log", """WITH t AS (SELECT o_orderkey % 5 AS stage, 1 + o_orderkey % 97 AS run, (1 + o_orderkey % 97) * (o_orderkey % 4) * 250000 AS cpu FROM orders)
  SELECT stage, count(*) AS tasks, round(sum(run) / 1000, 6) AS run_s, round(max(run) / 1000, 6) AS largest_s, round(max(run) * count(*) / sum(run), 6) AS imbalance, round(least(sum(cpu) / 1e6 / sum(run), 1), 6) AS busy FROM t GROUP BY ALL""")
def _event_log(spark, d):
    """Balance and idle share of the stages in an event log: one task for each order, with times made of its key."""
    run = c("o_orderkey") % 97 + 1
    metrics = F.struct(run.alias("Executor Run Time"), (run * (c("o_orderkey") % 4) * 250_000).alias("Executor CPU Time"))
    path = _folder(spark, "event-log")
    catalog.scan(spark, d, "orders").select(F.to_json(F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), (c("o_orderkey") % 5).alias("Stage ID"), metrics.alias("Task Metrics")))).write.text(path)
    return profile.stage_balance(spark, path).withColumns({k: F.round(k, 6) for k in ("run_s", "largest_s", "imbalance", "busy")})


_PLAN = "Project Filter LogicalRelation".split()


def _named(spark, d):
    return catalog.scan(spark, d, "nation").filter("n_nationkey > 3").select("n_name")


@_add("plan_json", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(_PLAN)) + ") AS t(place, node)")
def _plan_json(spark, d):
    nodes = [(k, n["class"].rpartition(".")[2]) for k, n in enumerate(profile.plan_json(_named(spark, d)))]
    return spark.createDataFrame(nodes, "place int, node string")


@_add("plan_dot", "SELECT * FROM (VALUES ('digraph plan {'), ('rankdir=BT;'), " + ", ".join(f"""('n{k} [label="{n}"];')""" for k, n in enumerate(_PLAN)) + ", ('n1 -> n0;'), ('n2 -> n1;'), ('}')) AS t(line)")
def _plan_dot(spark, d):
    return spark.createDataFrame([(x.strip(),) for x in profile.plan_dot(_named(spark, d)).splitlines()], "line string")


@_add("profile_report", "SELECT * FROM (VALUES ('| query | plain | split |'), ('|---|---|---|'), ('| a | 2.00 (1.00) | 1.00 (0.50) |'), ('| b |  | 3.00 |')) AS t(line)")
def _report(spark, d):
    return spark.createDataFrame([(x,) for x in profile.report({"a": {"plain": 2.0, "split": 1.0}, "b": {"split": 3.0}}).splitlines()], "line string")


@_add("log_table", "SELECT 'scan' AS query, count(*) AS n_rows FROM region UNION ALL SELECT 'twice', 2 * count(*) FROM region")
def _log(spark, d):
    """A benchmark log, a file of the driver: rows are appended, then read."""
    n = catalog.scan(spark, d, "region").count()
    with tempfile.TemporaryDirectory() as folder:
        for row in ({"query": "scan", "n_rows": n}, {"query": "twice", "n_rows": 2 * n}):
            profile.append_log(f"{folder}/log", row)
        rows = [(r["query"], r["n_rows"]) for r in profile.read_log(f"{folder}/log")]
    return spark.createDataFrame(rows, "query string, n_rows long")


# extensions beyond the inventory: what the benchmark's texts say about order


@_add("extension_top_revenue", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def _top(spark, d):
    return Rel.scan(spark, d, "lineitem").aggregate(["l_orderkey"], [("sum", c("l_extendedprice") * (1 - c("l_discount")), "revenue")]).map("revenue", F.round("revenue", 4)).result().orderBy(F.desc("revenue"), "l_orderkey").limit(10)
