"""Tables: schemas, the keys that join them, and readers and writers.

A catalog is plain data (it is saved as JSON); row counts and column statistics stay in the Parquet footers, where Spark
reads them itself.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "float": T.DoubleType(), "double": T.DoubleType(), "char": T.StringType(), "string": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType(), "long": T.LongType()}


@dataclass(frozen=True)
class Relationship:
    """Columns of one table that refer to columns of another; unique: the target has one row at most for a key."""

    source: tuple[str, ...]
    target: str
    keys: tuple[str, ...]
    unique: bool


@dataclass
class Table:
    """A table's columns with their declared types, and its relationships."""

    name: str
    columns: dict[str, str]
    primary: tuple[str, ...] = ()
    relationships: list[Relationship] = field(default_factory=list)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[t]) for c, t in self.columns.items()])


class Catalog:
    """Named tables."""

    def __init__(self, tables: dict[str, Table]) -> None:
        self.tables = tables

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"unknown table {name}")
        return self.tables[name]

    def relationship(self, source: str, columns: tuple[str, ...], target: str) -> Relationship:
        """The declared relationship from these columns to target."""
        for r in self[source].relationships:
            if r.source == tuple(columns) and r.target == target:
                return r
        raise KeyError(f"no relationship from {source}{tuple(columns)} to {target}")

    def to_json(self) -> str:
        return json.dumps({n: asdict(t) for n, t in self.tables.items()}, indent=1)

    def save(self, path: str) -> None:
        """Writes a file of the driver."""
        with open(path, "w") as out:
            out.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> Catalog:
        with open(path) as lines:
            return cls.from_json(lines.read())

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        raw = json.loads(text)
        return cls({n: Table(t["name"], t["columns"], tuple(t["primary"]), [Relationship(tuple(r["source"]), r["target"], tuple(r["keys"]), r["unique"]) for r in t["relationships"]]) for n, t in raw.items()})


def _columns(text: str) -> dict[str, str]:
    return dict(pair.split(":") for pair in text.split())


def _catalog() -> Catalog:
    tables = {
        "region": Table("region", _columns("r_regionkey:int r_name:string r_comment:string"), ("r_regionkey",)),
        "nation": Table("nation", _columns("n_nationkey:int n_name:string n_regionkey:int n_comment:string"), ("n_nationkey",)),
        "supplier": Table("supplier", _columns("s_suppkey:int s_name:string s_address:string s_nationkey:int s_phone:string s_acctbal:float s_comment:string"), ("s_suppkey",)),
        "customer": Table("customer", _columns("c_custkey:int c_name:string c_address:string c_nationkey:int c_phone:string c_acctbal:float c_mktsegment:string c_comment:string"), ("c_custkey",)),
        "part": Table("part", _columns("p_partkey:int p_name:string p_mfgr:string p_brand:string p_type:string p_size:int p_container:string p_retailprice:float p_comment:string"), ("p_partkey",)),
        "partsupp": Table("partsupp", _columns("ps_partkey:int ps_suppkey:int ps_availqty:int ps_supplycost:float ps_comment:string"), ("ps_partkey", "ps_suppkey")),
        "orders": Table("orders", _columns("o_orderkey:int o_custkey:int o_orderstatus:char o_totalprice:float o_orderdate:date o_orderpriority:string o_clerk:string o_shippriority:int o_comment:string"), ("o_orderkey",)),
        "lineitem": Table("lineitem", _columns("l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:int l_extendedprice:float l_discount:float l_tax:float l_returnflag:char l_linestatus:char l_shipdate:date l_commitdate:date l_receiptdate:date l_shipinstruct:string l_shipmode:string l_comment:string"), ("l_orderkey", "l_linenumber")),
    }
    for source, columns, target, keys in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("lineitem", "l_partkey l_suppkey", "partsupp", "ps_partkey ps_suppkey"),
        ("partsupp", "ps_partkey", "part", "p_partkey"),
        ("partsupp", "ps_suppkey", "supplier", "s_suppkey"),
    ):
        a, b = tuple(columns.split()), tuple(keys.split())
        tables[source].relationships.append(Relationship(a, target, b, True))
        tables[target].relationships.append(Relationship(b, source, a, False))
    return Catalog(tables)


#: The eight tables of the benchmark and their keys.
TPCH = _catalog()


def scan(spark: SparkSession, folder: str, name: str, alias: str | None = None) -> DataFrame:
    """A table, its columns addressable under the alias too."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.alias(alias or name)


def read_tbl(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A `|`-separated file without quotes or header, spaces around fields trimmed, and a separator at each line's end."""
    raw = T.StructType([*(T.StructField(c, T.StringType()) for c in table.columns), T.StructField("_end", T.StringType())])
    lines = spark.read.schema(raw).option("sep", "|").option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return lines.select(*(as_date(F.col(c)).alias(c) if t == "date" else F.col(c).cast(_TYPES[t]).alias(c) for c, t in table.columns.items()))


def as_date(text) -> DataFrame:
    """A date from `YYYY-MM-DD`."""
    return F.to_date(text, "yyyy-MM-dd")


def write_tbl(df: DataFrame, path: str) -> None:
    """The counterpart of read_tbl: every line ends with a separator."""
    df.select(*(F.col(c).cast("string").alias(c) for c in df.columns), F.lit("").alias("_end")).write.mode("overwrite").option("sep", "|").option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A whole result as Parquet, CSV (with header), JSON or ORC."""
    out = df.write.mode("overwrite")
    (out.option("header", True).csv if kind == "csv" else getattr(out, kind))(path)


#: Rows of one bucket, about: a task takes a whole bucket.
BUCKET_ROWS = 1_000_000


def buckets_for(*tables: DataFrame) -> int:
    """Buckets for tables that are joined by them, 8 at least: as many as leave BUCKET_ROWS rows of the largest table in each, so that no task's part grows with the tables. Rows of Parquet files are counted by their footers."""
    return max(8, *(-(-t.count() // BUCKET_ROWS) for t in tables))


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table bucketed and sorted by a join key: joins and aggregates on it need no shuffle. path: its folder, instead of the warehouse's.

    Rows are shuffled to their buckets first, so that each is one file; else there would be as many files of each as tasks that write."""
    out = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (out.option("path", path) if path else out).saveAsTable(name)
    return df.sparkSession.table(name)


def fan_out(source: DataFrame, target: DataFrame, relationship: Relationship) -> DataFrame:
    """How many source rows have how many targets: n_targets, n_rows. Counted per key first, so a hot key is one row."""
    keys = [F.col(s) == F.col(k) for s, k in zip(relationship.source, relationship.keys)]
    left = source.groupBy(*relationship.source).agg(F.count(F.lit(1)).alias("sources"))
    right = target.groupBy(*relationship.keys).agg(F.count(F.lit(1)).alias("targets"))
    return left.join(right, keys, "left").groupBy(F.coalesce("targets", F.lit(0)).cast("long").alias("n_targets")).agg(F.sum("sources").cast("long").alias("n_rows"))
