"""Imbalance and time: how evenly rows lie over partitions, and how long plans take."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows in each non-empty partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_rows"))


def imbalance(df: DataFrame, partitions: int) -> DataFrame:
    """One row: n_rows, largest, and imbalance, the largest partition's rows over the mean of all partitions."""
    each = partition_rows(df)
    total, largest = F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long"), F.coalesce(F.max("n_rows"), F.lit(0)).cast("long")
    return each.agg(total.alias("n_rows"), largest.alias("largest")).withColumn("imbalance", F.when(F.col("n_rows") > 0, F.col("largest") * partitions / F.col("n_rows")).otherwise(1.0))


def key_imbalance(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, n_keys, largest (rows of the hottest key) and imbalance (largest over the mean of a key)."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest")).withColumn("imbalance", F.col("largest") * F.col("n_keys") / F.col("n_rows"))


def timed(make: Callable[[], DataFrame], runs: int = 3) -> list[float]:
    """Seconds of each run of a plan whose result is thrown away."""
    out = []
    for _ in range(runs):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - start)
    return out


def stage_balance(spark: SparkSession, event_log: str) -> DataFrame:
    """Of each stage in an event log: stage, tasks, run_s, largest_s, imbalance (the longest task over the mean) and busy (the
    share of the tasks' run time that was CPU time)."""
    metrics = T.StructType([T.StructField("Executor Run Time", T.LongType()), T.StructField("Executor CPU Time", T.LongType())])
    schema = T.StructType([T.StructField("Event", T.StringType()), T.StructField("Stage ID", T.LongType()), T.StructField("Task Metrics", metrics)])
    ends = spark.read.schema(schema).json(event_log).filter("Event = 'SparkListenerTaskEnd' AND `Task Metrics` IS NOT NULL")
    task = ends.select(F.col("Stage ID").alias("stage"), (F.col("Task Metrics")["Executor Run Time"] / 1e3).alias("run"), (F.col("Task Metrics")["Executor CPU Time"] / 1e9).alias("cpu"))
    each = task.groupBy("stage").agg(F.count(F.lit(1)).alias("tasks"), F.sum("run").alias("run_s"), F.max("run").alias("largest_s"), F.sum("cpu").alias("cpu_s"))
    some = F.col("run_s") > 0
    return each.select("stage", "tasks", "run_s", "largest_s", F.when(some, F.col("largest_s") * F.col("tasks") / F.col("run_s")).otherwise(1.0).alias("imbalance"), F.when(some, F.least(F.col("cpu_s") / F.col("run_s"), F.lit(1.0))).otherwise(1.0).alias("busy"))


def report(seconds: dict[str, dict[str, float]]) -> str:
    """A Markdown table of times by query (rows) and variant (columns), each relative to the first variant too."""
    variants = list(dict.fromkeys(v for own in seconds.values() for v in own))
    out = ["| query | " + " | ".join(variants) + " |", "|---" * (len(variants) + 1) + "|"]
    for query, own in seconds.items():
        base = own.get(variants[0])
        cells = [f"{own[v]:.2f} ({own[v] / base:.2f})" if v in own and base else f"{own[v]:.2f}" if v in own else "" for v in variants]
        out.append(f"| {query} | " + " | ".join(cells) + " |")
    return "\n".join(out)


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def plan_json(df: DataFrame) -> list:
    """The optimised logical plan as JSON."""
    return json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())


def plan_dot(df: DataFrame) -> str:
    """The optimised logical plan as a Graphviz graph."""
    nodes, out, stack = plan_json(df), ["digraph plan {", "  rankdir=BT;"], []
    for k, node in enumerate(nodes):  # nodes come before their children
        out.append(f'  n{k} [label="{node["class"].rpartition(".")[2]}"];')
        while stack and not stack[-1][1]:
            stack.pop()
        if stack:
            out.append(f"  n{k} -> n{stack[-1][0]};")
            stack[-1][1] -= 1
        stack.append([k, node.get("num-children", 0)])
    return "\n".join([*out, "}"])


def append_log(path: str, row: dict) -> None:
    """Adds a line of JSON to a benchmark log."""
    with open(path, "a") as out:
        out.write(json.dumps(row) + "\n")


def read_log(path: str) -> list[dict]:
    """The lines of a benchmark log."""
    with open(path) as lines:
        return [json.loads(line) for line in lines]
