"""Queries that SQL can't express, on the smallest test data, against plain loops."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import base_figures, coverage, fingerprint, library, near, overlap, quality, reads, sha, without_lines

import corpus_pipeline
from tessera.llm import language_id, line_dedup, queries
from tessera.llm import quality as rules

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def result(spark, name, *columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, DATA).select("doc_id", *columns).collect())


def test_op1(spark, docs):
    ids = [np.array(library.encode_ordinary(t), "<u4") for _, t in docs]
    assert result(spark, "op1_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == [(i, len(x), sha(x.tobytes()), sha(t.encode())) for (i, t), x in zip(docs, ids)]


def test_op2(spark, docs):
    got = result(spark, "op2_feistel_sharding", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert [r[:4] for r in got] == [(i, len(t.encode()) + 16, zlib.crc32(t.encode()), "rows") for i, t in docs]
    per = Counter(r[4] for r in got)
    assert set(per) <= set(range(40)) and max(per.values()) - min(per[s] for s in range(40)) <= 1
    assert all(sorted(r[5] for r in got if r[4] == s) == list(range(per[s])) for s in per) and {r[6] for r in got} == {None}


def test_op3(spark, docs):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
    expected = []
    for i, t in docs:
        n, item, size, covered, longest = overlap(t, items)
        expected.append((i, n, item, size, covered, longest, 2 * covered >= size > 0))
    assert result(spark, "op3_greedy_tiling", "n_items", "item_id", "item_tokens", "covered", "longest", "contaminated") == expected
    assert any(r[-1] for r in expected)


def test_op5(spark, docs):
    got = result(spark, "op5_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    assert [r[:7] for r in got] == [(i, *base_figures(t)) for i, t in docs]
    model = rules.train(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")))
    p = [quality(model, t) for _, t in docs]
    assert np.allclose([r[8] for r in got], p, atol=1e-4)
    assert all(r[7] == (not r[6] and x >= 0.5) for r, x in zip(got, p) if abs(x - 0.5) > 1e-3) and {r[7] for r in got} == {True, False}


def test_op5_held_out(spark):
    """The labels of documents that the model hasn't seen."""
    from tessera.llm import quality

    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 3 != 0")
    rest = labels.filter("doc_id % 3 = 0").withColumnRenamed("quality", "label")
    judged = quality.judge(documents, quality.train(documents, seen)).join(rest, "doc_id").filter("NOT base_failed").collect()
    assert len(judged) > 50 and sum(r["kept"] == (r["label"] == 1) for r in judged) / len(judged) > 0.95


def test_op7(spark, docs):
    expected, start = [], 0
    for i, t in docs:
        x = np.array([*library.encode_ordinary(t), 2], "<u4")
        expected.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert result(spark, "op7_token_files", "start", "n_tokens", "ids_crc32") == expected


def test_op9(spark, docs):
    got = result(spark, "op9_language_id", "held_out", "lang_pred", "score")
    net = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    some = [k for k, (_, t) in enumerate(docs) if len(t) < 3000]
    for k in some:
        share = reads(net, docs[k][1].encode())
        letter = bool(re.search(r"[^\W\d_]", docs[k][1]))
        assert got[k][:3] == (docs[k][0], zlib.crc32(str(docs[k][0]).encode()) % 4 == 2, net.languages[share.argmax()] if letter else "und")
        assert abs(got[k][3] - (share.max() if letter else 0)) < 1e-3
    assert len(some) > 100


def test_op9_held_out(spark):
    got = queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got) and len(got) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97


def test_op10(spark, docs):
    prints, links, least, _ = near(docs)
    assert result(spark, "op10_simhash_neardup", "fingerprint", "n_near", "component_id") == [(i, f"{p:016x}", n, c) for (i, _), p, n, c in zip(docs, prints, links, least)]


def test_pipeline(spark, docs):
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    net = language_id.train(frame)
    mean = [net.sums([t.encode()])[0] / len(t.encode()) for _, t in docs]  # held against loops in test_op9
    share = [np.exp(m - m.max()) / np.exp(m - m.max()).sum() for m in mean]
    left = [d for d, s in zip(docs, share) if s.max() >= corpus_pipeline.LEAST_SCORE]
    left = [(i, t) for (i, _), t in zip(left, without_lines(left, line_dedup.MIN_DOCS))]
    least = near(left, corpus_pipeline.SHINGLE, corpus_pipeline.FAMILIES)[2]
    left = [d for d, c in zip(left, least) if d[0] == c]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if coverage(t, items) < 0.5]
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_crc32"]) for r in queries.QUERIES["pipeline"](spark, DATA).collect())
    expected = [(i, library.encode_ordinary(t), zlib.crc32(t.encode())) for i, t in left]
    assert got == [(i, len(x), np.array(x, "<u4").tobytes(), c) for i, x, c in expected] and len(got) > 100
    assert fingerprint("") == 0
