"""Line dedup by a log-template tree of fixed depth.

A line's tokens are its runs without white space; fields (tokens with a digit, an `@` or `://`) are masked. The tree's
first level is the number of tokens, its further DEPTH levels are the leading tokens; below them lies a leaf. In a leaf of at
least MIN_DOCS lines, what varies is generalised: at each later place a token that MIN_DOCS lines of the leaf hold there is constant, any
other is variable, like a field. A line's template is its leaf with its constant tokens; a line belongs to it if SIMILAR of its tokens that aren't fields
are constant (leading ones are), and one at least. Templates of at least MIN_DOCS documents recur. Of a recurring
template the first line of the first document (by doc_id) stays and all other lines are dropped, so boilerplate and
copied passages are left once.

Leaves are counted by partial aggregates in a first pass. What the second pass gets of them is a map of 2**BITS bits, 16 MB
at any size: a leaf whose bit is set by another is sorted out by exact counts later. Tokens are counted, and joined with the
frequent ones, for lines of such leaves alone. Keys are 64-bit hashes, of templates 128 bits.

Defined results: a null text stays null and has no lines; lines without a token are kept and count neither as lines nor
as dropped; a text all of whose lines go is empty; rows that agree in doc_id and text are one document, and all of them keep
a first line (their lines count once a row in leaves); a null doc_id comes before all others, and of one doc_id's texts the one of least hash; other columns
stay as they are (n_chars, where there is one, follows the text); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, apart, arrow_map, cut, keyed, signed

MIN_DOCS, DEPTH, SIMILAR, BITS = 10, 2, (3, 4), 27
_FIELD = re.compile(rb"[0-9@]|://")


def leaf(words: list[bytes]) -> int:
    """The hash of the leaf that a line of these tokens (one at least) comes to."""
    return xxhash.xxh64_intdigest(b"%d %s" % (len(words), b" ".join([b"<*>" if _FIELD.search(w) else w for w in words[:DEPTH]])))


def keys(words: list[bytes], place: int) -> tuple[list[int], int, int]:
    """Keys of the line itself and of its tokens beyond DEPTH that aren't fields, each with leaf and place; how many leading
    tokens, and how many in all, aren't fields."""
    head = b"%d " % place
    plain = [not _FIELD.search(w) for w in words]
    own = [xxhash.xxh64_intdigest(head)] + [xxhash.xxh64_intdigest(b"%s%d %s" % (head, k, w)) for k, w in enumerate(words[DEPTH:], DEPTH) if plain[k]]
    return own, sum(plain[:DEPTH]), sum(plain)


def _lines(texts: list[bytes | None]) -> tuple[list[int], list[int], list[list[bytes]], np.ndarray]:
    """Row, number, tokens and leaf of every line with a token."""
    rows, numbers, tokens = [], [], []
    for row, text in enumerate(texts):
        for k, line in enumerate(text.split(b"\n") if text else ()):
            if words := line.split():
                rows.append(row)
                numbers.append(k)
                tokens.append(words)
    return rows, numbers, tokens, np.fromiter(map(leaf, tokens), np.uint64, len(tokens))


def _frequent(docs: DataFrame, least: int) -> np.ndarray:
    """The map of leaves with at least so many lines."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = np.unique(_lines(batch.column("text").to_pylist())[3], return_counts=True)
        return pa.record_batch([pa.array(signed(found)), pa.array(n)], ["leaf", "n"])

    counted = arrow_map(docs.select(F.col("text").cast("binary").alias("text")), count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.shiftrightunsigned("leaf", 64 - BITS)
    words = counted.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(leaf, {64 - BITS}) & 63 AS INT)))").alias("bits")).toArrow()  # 2 ** (BITS - 6) rows at most
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def generalised(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """Lines that belong to a template: kid, th, line, the template's hashes t1 and t2, and the keys of its constant tokens. Rows that agree in kid and th
    come once."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, least))  # of fixed size

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, numbers, tokens, place = _lines(batch.column("text").to_pylist())
        bit = place >> np.uint64(64 - BITS)
        at = np.flatnonzero(shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
        found = [keys(tokens[i], int(place[i])) for i in at.tolist()]
        row = np.array(rows, np.int64)[at]
        own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) for k, _, _ in found)]), pa.int32()), pa.array(np.array([x for k, _, _ in found for x in k], np.uint64).view(np.int64)))
        col = lambda c: pa.array(batch.column(c).to_numpy()[row])
        return pa.record_batch([col("kid"), col("th"), pa.array(np.array(numbers, np.int64)[at], pa.int32()), own, pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], ["kid", "th", "line", "keys", "lead", "plain"])

    lines = cut(arrow_map(keyed(docs).select("kid", "th", "text"), parse, "kid long, th long, line int, keys array<long>, lead int, plain int"))
    each = lines.select("kid", "th", "line", "lead", "plain", F.explode("keys").alias("key"))
    frequent = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # both sides are shuffled for this join alone: only then does AQE split a hot token; the sets are partial aggregates
    found = each.withColumn("key", apart("key")).join(frequent.select(apart("key")), "key").groupBy("kid", "th", "line", "lead", "plain").agg(F.sort_array(F.collect_set("key")).alias("constant"))
    n = F.size("constant") - 1 + F.col("lead")  # one key is the line's own
    similar = found.filter((n * SIMILAR[1] >= F.col("plain") * SIMILAR[0]) & (n > 0))
    return similar.select("kid", "th", "line", F.xxhash64("constant").alias("t1"), F.xxhash64(F.lit(1), "constant").alias("t2"), "constant")


def _recurring(lines: DataFrame, least: int) -> DataFrame:
    """t1, t2, n_docs and first (kid, th, line) of templates of at least so many documents."""
    each = lines.groupBy("t1", "t2", "kid", "th").agg(F.min("line").alias("line"))
    return each.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("kid", "th", "line")).alias("first")).filter(F.col("n_docs") >= least)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Recurring templates, written out, with their number of documents; variable tokens are `<*>`."""
    lines = cut(generalised(docs, min_docs))
    firsts = _recurring(lines, min_docs).select("n_docs", "t1", "t2", "first.*").join(lines, ["t1", "t2", "kid", "th", "line"])
    # of rows that agree in kid and th one is enough
    texts = keyed(docs).select("kid", "th", "text").join(firsts.select("kid", "th").distinct(), ["kid", "th"], "left_semi").dropDuplicates(["kid", "th"])

    def written(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, line, constant in zip(*(batch.column(c).to_pylist() for c in ("text", "line", "constant"))):
            words, held = text.split(b"\n")[line].split(), {(k ^ 1) & (1 << 64) - 1 for k in constant}
            place = leaf(words)
            own = iter(keys(words, place)[0][1:])
            out.append(b" ".join(b"<*>" if _FIELD.search(w) or (k >= DEPTH and next(own) not in held) else w for k, w in enumerate(words)).decode("utf-8", "replace"))
        return pa.record_batch([pa.array(out, pa.string()), batch.column("n_docs")], ["template", "n_docs"])

    return arrow_map(texts.join(firsts, ["kid", "th"]).select("text", "line", "constant", "n_docs"), written, "template string, n_docs long")


def marked(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Each row of docs as column doc, its text as binary, and the numbers of its lines that go (null: none)."""
    lines = cut(generalised(docs, min_docs).drop("constant"))
    # cut, so that the join's sides are shuffled for it alone: only then does AQE split a hot template
    common = cut(_recurring(lines, min_docs).select("t1", "t2", "first"))
    stays = (F.col("kid") == F.col("first.kid")) & (F.col("th") == F.col("first.th")) & (F.col("line") == F.col("first.line"))
    gone = lines.join(common, ["t1", "t2"]).filter(~stays).groupBy("kid", "th").agg(F.collect_set("line").alias("gone"))
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64("text").alias("th"), F.struct(*docs.columns).alias("doc"))
    # rows that agree in kid and th can be many: shuffled for this join alone too
    return whole.withColumn("kid", apart("kid")).join(gone.select(apart("kid"), "th", "gone"), ["kid", "th"], "left").select("doc", F.col("doc.text").cast("binary").alias("text"), "gone")


def _clean(text: bytes | None, gone: list[int] | None) -> bytes | None:
    """The text without its lines of these numbers."""
    if not gone:
        return text
    drop = set(gone)
    return b"\n".join([line for k, line in enumerate(text.split(b"\n")) if k not in drop])


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with recurring lines dropped from text."""
    joined = marked(docs, min_docs)
    names = docs.columns
    rest = [c for c in names if c.lower() != "text"]
    flat = joined.select("text", "gone", *(F.col("doc")[c].alias(f"_{k}") for k, c in enumerate(rest)))
    schema = "text string, " + ", ".join(f"_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(rest))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(map(_clean, batch.column("text").to_pylist(), batch.column("gone").to_pylist()))
        return pa.record_batch([pa.array(texts, pa.binary()).cast(pa.string()), *(batch.column(f"_{k}") for k in range(len(rest)))], ["text", *(f"_{k}" for k in range(len(rest)))])

    out = arrow_map(flat, run, schema)
    place = {c: F.col(f"_{k}") for k, c in enumerate(rest)}
    if "n_chars" in place:
        place["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*((F.col("text") if c.lower() == "text" else place[c]).alias(c) for c in names))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = batch.column("text").to_pylist(), batch.column("gone").to_pylist()
        n = [sum(map(bool, map(bytes.strip, t.split(b"\n")))) if t else 0 for t in texts]
        return pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64()), pa.array([hashlib.sha256(_clean(t, g) or b"").hexdigest() for t, g in zip(texts, gone)])], ["doc_id", "n_lines", "n_dropped", "text_sha256"])

    return arrow_map(marked(docs).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "text", "gone"), run, "doc_id long, n_lines long, n_dropped long, text_sha256 string")


SQL = {
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(ls) WITH ORDINALITY AS t(line, k)
), t AS (
  SELECT doc_id, k, line, w, len(w) AS n, len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9@]|://'))) AS plain,
    len(list_filter(w[1:2], lambda x: NOT regexp_matches(x, '[0-9@]|://'))) AS lead,
    len(w) || ' ' || array_to_string(list_transform(w[1:2], lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END), ' ') AS leaf
  FROM l
), leaves AS (
  SELECT leaf FROM t WHERE n > 0 GROUP BY leaf HAVING count(*) >= 10
), tokens AS (
  SELECT doc_id, k, leaf, p, w[p] AS token FROM t JOIN leaves USING (leaf), unnest(range(3, n + 1)) AS u(p) WHERE NOT regexp_matches(w[p], '[0-9@]|://')
), frequent AS (
  SELECT leaf, p, token FROM tokens GROUP BY ALL HAVING count(*) >= 10
), constant AS (
  SELECT doc_id, k, count(*) AS c, string_agg(p || ' ' || token, ' ' ORDER BY p) AS s FROM tokens JOIN frequent USING (leaf, p, token) GROUP BY doc_id, k
), template AS (
  SELECT t.doc_id, t.k, t.leaf || ' ' || coalesce(s, '') AS template FROM t JOIN leaves USING (leaf) LEFT JOIN constant USING (doc_id, k)
  WHERE lead + coalesce(c, 0) > 0 AND (lead + coalesce(c, 0)) * 4 >= plain * 3
), common AS (
  SELECT template, min(doc_id) AS doc FROM template GROUP BY template HAVING count(DISTINCT doc_id) >= 10
), stays AS (
  SELECT template, doc, min(k) AS k FROM common JOIN template USING (template) WHERE doc_id = doc GROUP BY template, doc
), gone AS (
  SELECT t.doc_id, t.k FROM template t JOIN stays s USING (template) WHERE NOT (t.doc_id = s.doc AND t.k = s.k)
), marked AS (
  SELECT t.*, g.k IS NOT NULL AS gone FROM t LEFT JOIN gone g USING (doc_id, k)
)
SELECT d.doc_id, count(m.k) FILTER (WHERE n > 0) AS n_lines, count(m.k) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY m.k) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
""",
}
