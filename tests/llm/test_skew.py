"""A hot passage, a hot line, a hot text and a large component: AQE splits the joins that they meet in, and the results stay whole."""

import random

import pytest

from tessera.llm import line_dedup, simhash, substring_dedup

CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def hot(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randint(0, 500)}" for _ in range(38))
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    rows = [(i, f"a{i} {passage} b{i}\nAll rights reserved 2020 by us") for i in range(4000)]
    yield spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ran(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("skew=true")


def test_hot_passage(hot):
    rows, split = ran(substring_dedup.duplicate_spans(hot).select("doc_id", "n_words", "n_removed"))
    assert split >= 1 and len(rows) == 4000
    assert {(r["n_words"], r["n_removed"]) for r in rows} == {(46, 38)}


def test_hot_line(hot):
    rows, split = ran(line_dedup.drop_recurring(hot))
    assert split >= 1 and len(rows) == 4000
    assert [r["doc_id"] for r in rows if "rights" in r["text"]] == [0]


@pytest.fixture
def copies(spark, hot):
    """A third of all rows hold one text, the others have their own."""
    text = " ".join(f"c{i}" for i in range(40))
    return spark.createDataFrame([(i, text if i % 3 == 0 else f"d{i} e{i} f{i} g{i}") for i in range(6000)], "doc_id long, text string").repartition(8)


def test_hot_text(copies):
    rows, split = ran(substring_dedup.duplicate_spans(copies).select("doc_id", "n_words", "n_removed"))
    assert split >= 1 and {(r["doc_id"] % 3 == 0, r["n_words"], r["n_removed"]) for r in rows} == {(True, 40, 40), (False, 4, 0)} and len(rows) == 6000


def test_hot_fingerprint(copies):
    rows, split = ran(simhash.near_duplicates(copies).select("doc_id", "n_near", "component_id"))
    assert split >= 1 and len(rows) == 6000
    assert {(r["n_near"] >= 1999, r["component_id"]) for r in rows if r["doc_id"] % 3 == 0} == {(True, 0)}


def test_hot_root(spark, hot):
    """A star: after one round every value of a component leads to its root."""
    roots = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame([(0, i) for i in range(1, 5000)] + [(i, i + 1) for i in range(1, 5000, 7)], "x long, y long").repartition(8)).collect()}
    assert set(roots.values()) == {0} and {*range(1, 5001)} - {0} <= {*roots, 5000}


def test_repeated_rows(spark, hot):
    """Four thousand rows that agree in doc_id and text."""
    docs = spark.createDataFrame([(7, "All rights reserved by us\nbody", str(random.random())) for _ in range(4000)] + [(k, f"All rights reserved by us\nown text {'abcdefghijkl'[k - 8] * 3} {k}", "") for k in range(8, 20)], "doc_id long, text string, more string").repartition(8)
    rows, split = ran(line_dedup.drop_recurring(docs))
    assert split >= 1 and len(rows) == 4012 and {r["text"] for r in rows if r["doc_id"] == 7} == {"All rights reserved by us\nbody"}
    assert sorted(r["doc_id"] for r in rows if "rights" not in r["text"]) == list(range(8, 20))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == list(range(7, 20))
