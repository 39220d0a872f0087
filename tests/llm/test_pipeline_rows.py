"""The pipeline over odd rows, empty tables and planted documents, against plain loops."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
from brute import WORDS, coverage, library, near, without_lines

import corpus_pipeline
from tessera.llm import language_id, line_dedup

DATA = "/root/testdata/sf0.001"
ITEMS = ["the quick brown fox jumps over one lazy dog while nine other small dogs sleep in sun", None, ""]


def folder(spark, path, docs, items=ITEMS):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def expected(rows, items):
    """Of (doc_id, text) rows that all have the one language: what is left, and its ids."""
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    left = [(i, t) for (i, _), t in zip(left, without_lines(left, line_dedup.MIN_DOCS))]
    first = {}
    for (i, t), root in zip(left, near(left, corpus_pipeline.SHINGLE, corpus_pipeline.FAMILIES)[3]):
        first[root] = min(first.get(root, (i, t)), (i, t), key=lambda r: (r[0] is not None, r[0] or 0))
    left = [(i, t) for i, t in first.values() if coverage(t, [x for x in items if x]) < 0.5]
    return sorted(((i, np.array(library.encode_ordinary(t), "<u4").tobytes(), zlib.crc32(t.encode())) for i, t in left), key=repr)


def test_odd_rows(spark, odd, tmp_path):
    more = spark.createDataFrame([(500, f"before {ITEMS[0]} after", "en", "s", 1, "k", None, 1, 2)], odd.schema)
    docs = odd.union(more)
    out = corpus_pipeline.run(spark, folder(spark, tmp_path / "odd", docs))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_crc32"]
    got = sorted(((r["doc_id"], bytes(r["ids"]), r["decoded_crc32"]) for r in out.collect()), key=repr)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS) and 500 not in {i for i, _, _ in got}


def test_stages_keep_columns(spark, odd, tmp_path):
    path, docs = folder(spark, tmp_path / "columns", odd), odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        assert {r["place"] for r in out.collect()} == {2}
        docs = out


def test_empty_tables(spark, none, odd, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", none)).count() == 0
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "unnamed", odd.filter("doc_id < 3"), [])).count() == 0  # null, empty, blank


def test_intermediate_folders_go(spark, odd, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("pipeline-*"))
    corpus_pipeline.run(spark, folder(spark, tmp_path / "in", odd)).count()
    (own,) = set(shared.glob("pipeline-*")) - before
    assert [p.name for p in own.iterdir() if p.is_dir()] == ["3-benchmark"]


def test_language_stage_rejects_mixtures_and_keeps_documents(spark):
    """Documents of one language stay, short ones too; most of those that mix four languages go, as do those without a letter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    by = {}
    for r in rows:
        if len(r["text"]) > 400:
            by.setdefault(r["lang"], []).append(r["text"])
    rng = random.Random(3)
    mixed = [(10**6 + k, "\n".join(w for a in rng.sample(sorted(by), len(by)) for w in [" ".join(WORDS.findall(rng.choice(by[a])[:400]))]), None) for k in range(60)]
    planted = mixed + [(2 * 10**6, "12 345 -- 6", None), (2 * 10**6 + 1, None, "en")]
    net = language_id.train(docs)
    kept = {r["doc_id"] for r in language_id.keep_known(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(planted, "doc_id long, text string, lang string")), net, corpus_pipeline.LEAST_SCORE).collect()}
    clean = [r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"])]
    assert sum(i in kept for i in clean) / len(clean) > 0.995
    assert sum(i in kept for i, _, _ in mixed) / len(mixed) < 0.7
    assert not kept & {2 * 10**6, 2 * 10**6 + 1}
