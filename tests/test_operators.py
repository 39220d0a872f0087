"""Properties and edge cases of the operators."""

import itertools
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import scalars as s
from tessera.operators import aggregates, graph, joins, profile, skew
from tessera.operators.relation import Rel
from tessera.sources import catalog


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(1)
    large = [(i, 1 if rng.random() < 0.9 else rng.randint(2, 30)) for i in range(800)] + [(900, None)]
    return frame(spark, large, "id long, k int"), frame(spark, [(k, k * 10) for k in range(0, 20)] + [(1, 11), (None, 5)], "k int, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join(hot, how):
    large, small = hot
    assert sorted(map(tuple, skew.salted_join(large, small, ["k"], how, salts=5).collect()), key=str) == sorted(map(tuple, large.join(small, ["k"], how).collect()), key=str)


def test_salted_join_refuses_outer(hot):
    with pytest.raises(ValueError):
        skew.salted_join(*hot, ["k"], "full")


def test_hot_keys(hot):
    assert [tuple(r) for r in skew.hot_keys(hot[0].filter("k IS NOT NULL"), ["k"], 0.5).select("k").collect()] == [(1,)]


def test_two_phase_is_the_aggregate(hot):
    reductions = [("count", None, "n"), ("count", "k", "nk"), ("sum", "id", "s"), ("avg", "id", "a"), ("min", "id", "low"), ("max", "id", "high")]
    two, one = skew.two_phase(hot[0], ["k"], reductions), aggregates.aggregate(hot[0], ["k"], reductions)
    assert sorted(map(tuple, two.select(*one.columns).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_unknown_reduction(hot):
    with pytest.raises(ValueError):
        aggregates.aggregate(hot[0], ["k"], [("median", "id", "m")])
    with pytest.raises(ValueError):
        aggregates.aggregate(hot[0], ["k"], [("sum", None, "m")])


def test_unique_join_matches_once(spark):
    left = frame(spark, [(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    right = frame(spark, [(1,), (1,), (3,)], "r int")
    assert sorted(map(tuple, joins.unique(left, right, [("k", "r")]).select("r", "v").collect())) == [(1, "a"), (1, "a")]
    assert sorted(map(tuple, joins.unique(left, right, [("k", "r")], ["v"]).select("r", "v").collect())) == [(1, "a"), (1, "a")]


def test_semi_and_anti_never_double(spark):
    left, right = frame(spark, [(1, 5), (1, 6)], "k int, v int"), frame(spark, [(1,), (2,), (None,)], "r int")
    assert [tuple(r) for r in joins.semi(left, right, [("k", "r")], F.col("v") > 4).collect()] == [(1,)]
    assert sorted((tuple(r) for r in joins.anti(left, right, [("k", "r")]).collect()), key=str) == [(2,), (None,)]


def test_not_in_with_nulls(spark):
    right = frame(spark, [(1,), (2,)], "r int")
    assert joins.not_in(frame(spark, [(1,), (None,)], "k int"), right, "k", "r").count() == 0
    assert [tuple(r) for r in joins.not_in(frame(spark, [(1,)], "k int"), right, "k", "r").collect()] == [(2,)]


def test_outer_counts_matches_alone(spark):
    left, right = frame(spark, [(1, 5)], "k int, v int"), frame(spark, [(1,), (2,)], "r int")
    out = aggregates.aggregate(joins.outer(left, right, [("k", "r")]), ["r"], [("count", "v", "n"), ("count", None, "rows")])
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1), (2, 0, 1)]


def test_empty_inputs(spark):
    empty = frame(spark, [], "k int, v double")
    assert tuple(aggregates.aggregate(empty, [], [("sum", "v", "s"), ("count", None, "n"), ("max", "v", "m")]).first()) == (None, 0, None)
    assert aggregates.aggregate(empty, ["k"], [("sum", "v", "s")]).count() == 0
    assert skew.two_phase(empty, ["k"], [("sum", "v", "s")]).count() == 0
    assert skew.hot_keys(empty, ["k"]).count() == 0
    assert tuple(profile.imbalance(empty, 4).first()) == (0, 0, 1.0)


def test_max_of_negatives(spark):
    assert aggregates.aggregate(frame(spark, [(-3.0,), (-1.5,)], "v double"), [], [("max", "v", "m")]).first()[0] == -1.5


@pytest.mark.parametrize(("text", "pattern", "expected"), [("A", "AA", False), ("AA", "A%A", True), ("A", "A%A", False), ("AXA", "A_A", True), ("", "%", True), ("", "_", False)])
def test_like(spark, text, pattern, expected):
    assert frame(spark, [(text,)], "t string").select(s.like(F.col("t"), pattern)).first()[0] is expected


@pytest.mark.parametrize(("start", "length", "expected"), [(1, 2, "ab"), (0, 2, "a"), (-3, 3, ""), (3, 9, "cd"), (9, 1, "")])
def test_substring(spark, start, length, expected):
    assert frame(spark, [("abcd",)], "t string").select(s.substring(F.col("t"), start, length)).first()[0] == expected


def test_division_by_zero_is_null(spark):
    assert frame(spark, [(1, 0), (7, 2)], "a int, b int").select(s.div(F.col("a"), F.col("b"))).collect() == [(None,), (3.5,)]


def test_names(spark):
    rel = Rel(frame(spark, [(1,)], "k int")).alias("a")
    with pytest.raises(AnalysisException):
        rel.project("nothing").result().collect()
    both = rel.theta(Rel(frame(spark, [(1,)], "k int")).alias("b"), F.col("a.k") == F.col("b.k"))
    with pytest.raises(AnalysisException):
        both.project("k").result().collect()
    assert both.project("a.k").result().count() == 1


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(4)
    return sorted({(a, b) for a, b in ((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(90)) if a != b})


def test_triangles(spark, edges):
    e = set(edges)
    expected = sorted((a, b, c) for a, b in e for c in range(15) if (a, c) in e and (b, c) in e)
    assert sorted(map(tuple, graph.triangles(frame(spark, edges, "src int, dst int")).select("a", "b", "c").collect())) == expected


def test_four_cliques(spark, edges):
    e, df = set(edges), frame(spark, edges, "src int, dst int")
    got = graph.extend(graph.triangles(df), df, ["a", "b", "c"], "d").select("a", "b", "c", "d").collect()
    assert sorted(map(tuple, got)) == sorted(q for q in itertools.permutations(range(15), 4) if all((q[i], q[j]) in e for i in range(4) for j in range(i + 1, 4)))


def test_multiway(spark):
    r, t = frame(spark, [(1, 2), (1, 3)], "a int, b int"), frame(spark, [(2, 5), (3, 6)], "b int, c int")
    assert sorted(map(tuple, graph.multiway([r, t, frame(spark, [(5, 1)], "c int, a int")]).select("a", "b", "c").collect())) == [(1, 2, 5)]
    with pytest.raises(ValueError):
        graph.multiway([r, frame(spark, [(1,)], "z int")])


def test_tbl(spark, tmp_path):
    path = tmp_path / "nation.tbl"
    path.write_text("0| ALGERIA |0|some words|\n1|ARG\"NTINA|1||\n")
    got = catalog.read_tbl(spark, str(path), catalog.TPCH["nation"]).collect()
    assert [tuple(r) for r in got] == [(0, "ALGERIA", 0, "some words"), (1, 'ARG"NTINA', 1, None)]


def test_catalog_file(tmp_path):
    path = str(tmp_path / "catalog.json")
    catalog.TPCH.save(path)
    again = catalog.Catalog.load(path)
    assert again.tables == catalog.TPCH.tables
    assert again.relationship("lineitem", ("l_partkey", "l_suppkey"), "partsupp").unique
    with pytest.raises(KeyError):
        again["nothing"]


def test_bucketed_join_has_no_shuffle(spark):
    a = catalog.write_bucketed(frame(spark, [(i % 7, i) for i in range(50)], "k int, v int"), "bucketed_a", ["k"], 4)
    b = catalog.write_bucketed(frame(spark, [(i, i) for i in range(7)], "k int, w int"), "bucketed_b", ["k"], 4)
    plan = profile.plan_text(a.hint("merge").join(b, "k"))
    assert "Exchange" not in plan
    assert a.join(b, "k").count() == 50


def test_filters_and_columns_reach_the_scan(spark):
    plan = profile.plan_text(Rel.scan(spark, "/root/testdata/sf0.001", "lineitem").where(F.col("l_quantity") < 3).project("l_orderkey").result())
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,3" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_profile(spark, tmp_path):
    df = frame(spark, [(i % 3,) for i in range(9)], "k int")
    assert tuple(profile.key_imbalance(df, ["k"]).first()) == (9, 3, 3, 1.0)
    assert profile.plan_json(df.filter("k > 1")) and profile.plan_dot(df.filter("k > 1")).startswith("digraph")
    assert len(profile.timed(lambda: df, 2)) == 2
    profile.append_log(str(tmp_path / "log"), {"q": 1})
    assert (tmp_path / "log").read_text() == '{"q": 1}\n'


def test_event_log(spark, tmp_path):
    end = '{"Event":"SparkListenerTaskEnd","Stage ID":%d,"Task Metrics":{"Executor Run Time":%d,"Executor CPU Time":%d}}'
    log = tmp_path / "log"
    log.write_text("\n".join(['{"Event":"SparkListenerLogStart"}', end % (3, 1000, 5 * 10**8), end % (3, 3000, 15 * 10**8), '{"Event":"SparkListenerTaskEnd","Stage ID":4}']))
    assert [tuple(r) for r in profile.stage_balance(spark, str(log)).collect()] == [(3, 2, 4.0, 3.0, 1.5, 0.5)]


def test_report():
    text = profile.report({"q1": {"plain": 2.0, "salted": 1.0}, "q2": {"plain": 1.0}})
    assert text.splitlines()[2:] == ["| q1 | 2.00 (1.00) | 1.00 (0.50) |", "| q2 | 1.00 (1.00) |  |"]


def test_stream(spark, tmp_path):
    from tessera.streaming import incremental

    source = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.scan_stream(spark, str(tmp_path / "in"), source, 1)
    query = incremental.keep_aggregate(stream, ["o_orderstatus"], [("count", None, "n")], "status_counts", str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("status_counts").collect())) == sorted(map(tuple, source.groupBy("o_orderstatus").count().collect()))
