r"""Chat formatting over reply trees.

Messages name their parent. Self-joins double each message's link, from its parent to the message 2, 4, 8, ... above it, with
the scores between them, until every link has passed its root; each round is cut by a checkpoint, and there are as many
as the logarithm of the deepest tree. The same links then enumerate the paths of the chosen leaves. Branches of a conversation are ranked by the mean score along the path (ties: the
longer, then the least leaf id), and the chosen paths are formatted, each as one conversation.

The template: each turn is `### Role: text</turn>` and a newline. Inside roles and texts a backslash, `###` and `</turn>`
get a backslash before them, so control strings never occur unescaped and reading back is exact. A role other than user,
assistant and system is written after an equals sign, with its colons escaped too.

Defined results: a null text or role is empty; a null score is 0; messages whose ancestors loop or are missing are on
no path; of rows with the same conversation and id the least by (parent, role, text) counts; an empty table gives no rows;
other columns are ignored. As a chain (`chain`), rows of a conversation follow each other by turn (null turns first), then role and text.
Messages with a null conv_id are one conversation, whose conv_id stays null. A conversation is one row of the result, a
string, so its chosen path is held by one task; that bounds the length of one, not the number of them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
_BACK = {v: k for k, v in NAMES.items()}
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ([^\\:]*(?:\\[\s\S][^\\:]*)*): ([^\\<]*(?:(?:\\[\s\S]|<(?!/turn>))[^\\<]*)*)</turn>\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> str:
    """One conversation from (role, text) pairs."""
    return "".join(f"### {NAMES.get(role) or '=' + escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n" for role, text in turns)


def parsed(conversation: str) -> list[tuple[str, str, int, int]]:
    """Role and text of each turn, and where in the conversation the escaped text lies: the loss mask of that turn."""
    out, at = [], 0
    while at < len(conversation):
        turn = _TURN.match(conversation, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        label = turn[1]
        out.append((_BACK[label] if label in _BACK else unescape(label[1:]), unescape(turn[2]), turn.start(2), turn.end(2)))
        at = turn.end()
    return out


def chain(rows: DataFrame) -> DataFrame:
    """conv_id, id, parent, role, text, score of conversations without branches: the parent is the row before."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return (
        rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), "turn", "role", "text")
        .withColumn("id", F.row_number().over(order).cast("long"))
        .select(F.col("conv").alias("conv_id"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    )


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each conversation: conv_id, branch (1: best), place, role, text. messages has conv_id,
    id, parent (null at a root), role, text, score."""
    first = Window.partitionBy("conv_id", "id").orderBy("parent", "role", "text")
    nodes = cut(
        messages.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_id"), "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    )
    keys = nodes.select("conv_id", "id", F.lit(True).alias("there"))
    parents = nodes.filter("parent IS NOT NULL").select("conv_id", F.col("parent").alias("id"), F.lit(True).alias("inner")).distinct()
    # a message with a missing parent is made its own, so that like any loop it never comes to an end
    up = F.when(F.col("parent").isNotNull() & F.col("there").isNull(), F.col("id")).otherwise(F.col("parent"))
    links = nodes.join(keys.withColumnRenamed("id", "parent"), ["conv_id", "parent"], "left").select("conv_id", "id", up.alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    links = cut(links.join(parents, ["conv_id", "id"], "left").select("conv_id", "id", "up", "total", "n", F.col("inner").isNull().alias("leaf")))
    most = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = []  # jumps[k]: from each message to the one 2**k above it
    while 1 << len(jumps) < most and not links.filter("up IS NOT NULL").isEmpty():
        jump = links.filter("up IS NOT NULL")
        jumps.append(jump.select("conv_id", "id", "up"))
        above = links.select("conv_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("n").alias("n2"))
        links = cut(links.join(above, ["conv_id", "up"], "left").select("conv_id", "id", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), "leaf"))
    rank = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "id")
    chosen = links.filter("leaf AND up IS NULL").withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= best)
    paths = chosen.select("conv_id", "branch", "id", (F.col("n") - 1).alias("place"))
    for k, jump in enumerate(jumps):  # each number of steps is one sum of powers of two, so each message comes once
        paths = cut(paths.union(paths.join(jump, ["conv_id", "id"]).select("conv_id", "branch", F.col("up").alias("id"), (F.col("place") - (1 << k)).alias("place"))))
    return paths.join(nodes.select("conv_id", "id", "role", "text"), ["conv_id", "id"]).select("conv_id", "branch", F.col("place").cast("int").alias("place"), "role", "text")


def conversations(paths: DataFrame) -> DataFrame:
    """conv_id, branch and formatted text of every path."""
    # the result is one string for each path, so its turns meet in one row
    turns = paths.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            texts = [formatted([(t["role"], t["text"]) for t in ts]) for ts in batch.column("turns").to_pylist()]
            yield pa.record_batch([batch.column("conv_id"), batch.column("branch"), pa.array(texts, pa.string())], ["conv_id", "branch", "formatted"])

    return turns.mapInArrow(run, "conv_id long, branch int, formatted string").withColumn("conv_id", F.when(F.col("conv_id") != NULL_ID, F.col("conv_id")))


def digests(texts: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives, as counts and digests."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text in batch.column("formatted").to_pylist():
                turns = parsed(text)
                loss = "".join(unescape(text[a:b]) for role, _, a, b in turns if role == "assistant")
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{role}\n{t}\n" for role, t, _, _ in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(v) for v in out.values())], ["conv_id", *out])

    return texts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(conversations(best_paths(chain(rows.unionByName(tricky)))))


SQL = {
    "op4_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 14 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
}
