"""Odd rows and empty tables through every operator, against brute force where the result has one value."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import base_figures, library, near, overlap, reads, sha, tiles, without_lines
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, decontaminate, language_id, line_dedup, quality, sharding, simhash, substring_dedup, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def inputs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_bpe(odd, none):
    expected = []
    for i, t in inputs(odd):
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert table(bpe.digests(odd, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert bpe.digests(none, RANKS).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet=st.sampled_from(list("-= \nabthe1é日")), max_size=600)))
def test_any_text_is_encoded_as_by_the_library(codec, text):
    text = text.encode("utf-8", "replace").decode()
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["-", "=", "a", "\n", "ab", "é", None])
def test_a_long_match(codec, unit):
    """The library takes time in the square of a match's length, so it is asked for a shorter one."""
    make = lambda n: unit * (n // len(unit)) if unit else "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=n))
    assert np.frombuffer(codec.encode(make(6000)), "<u4").tolist() == library.encode_ordinary(make(6000))
    begun = time.process_time()
    assert codec.decode(codec.encode(make(1_000_000))) == make(1_000_000).encode()
    assert time.process_time() - begun < 60


def test_merges_with_a_heap_are_the_merges(codec):
    rng = random.Random(1)
    for k in range(200):
        piece = "".join(rng.choices("aeths -=", k=rng.randint(1, 200))).encode()
        units = [piece[i : i + 1] for i in range(len(piece))]
        while ranked := [(codec.ranks[units[i] + units[i + 1]], i) for i in range(len(units) - 1) if units[i] + units[i + 1] in codec.ranks]:
            i = min(ranked)[1]
            units[i : i + 2] = [units[i] + units[i + 1]]
        assert codec.merge_long(piece) == [codec.ranks[u] for u in units]


def test_sharding(odd, none):
    rows = sharding.shard(odd, 7).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in inputs(odd)), key=repr)
    assert sorted(r["number"] for r in rows) == list(range(len(rows)))
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per[s] for s in range(7)) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s])) for s in per)
    assert sorted(map(tuple, sharding.shard(odd, 7).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert sharding.shard(none, 7).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_feistel(n):
    f = sharding.Feistel(n)
    p = f(np.arange(n))
    assert sorted(p) == list(range(n)) and list(f.inverse(p)) == list(range(n))


def test_quality(odd, none, spark):
    base = quality.judge(odd, quality.Model(np.zeros(quality.DIMENSIONS), 0.0, 0.0, 40.0)).collect()
    expected = [(i, *(x := base_figures(t)), not x[-1]) for i, t in inputs(odd)]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r[k] for k in names) for r in base), key=repr) == sorted(expected, key=repr)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12, 24)] + [(None, 1, 0), (15, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd, quality.train(odd, labels)).count() == odd.count()
    assert quality.judge(odd, quality.train(odd, labels.limit(0))).count() == odd.count()
    assert quality.judge(none, quality.train(none, labels)).count() == 0


def test_quality_sample_is_bounded(spark):
    """Many documents of one labelled doc_id, and long ones: neither rows nor bytes beyond the bound reach the driver."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(400)] + [(2, "long word " * 20_000)] + [(3, "same")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, 4).collect()
    assert len(rows) == 4 and all(len(r["excerpt"]) <= quality.EXCERPT for r in rows)
    whole = quality.sample(docs, labels, 1000).collect()
    assert Counter(r["quality"] for r in whole) == {1: 401, 0: 1}
    assert len(quality.sample(docs, labels, 1).collect()) <= 1


def test_token_files(odd, none, tmp_path):
    tokenizer, out = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/files"
    rows = token_files.read_shards(token_files.write_shards(odd, out, tokenizer), out).collect()
    expected, start = [], 0
    ids = {}
    for i, t in sorted(inputs(odd), key=lambda r: (r[0] is not None, r[0] or 0)):
        x = np.array([*library.encode_ordinary(t or ""), 2], "<u4")
        expected.append((i, start, len(x), zlib.crc32(x.tobytes())))
        ids[start] = x
        start += len(x)
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == expected
    files = sorted((tmp_path / "files").glob("*.tsra"))
    k = 0
    for f in files:
        reader = token_files.Reader(f.read_bytes())
        for j in range(len(reader.sizes)):
            whole = ids[expected[k][1]]
            assert reader.document(j).tolist() == whole.tolist()
            assert reader.range(j, 2, 9).tolist() == whole[2:9].tolist()
            k += 1
    assert k == len(expected)
    assert token_files.read_shards(token_files.write_shards(none, f"{out}-none", tokenizer), f"{out}-none").count() == 0


def test_repair_rules_are_used():
    ids = np.array(list(b"the cat the cat the cat the dog " * 40), np.uint32)
    g = token_files.repair(ids, np.array([0, 640]), 256, 12, 3, 2)
    assert len(g.symbols) < len(ids) / 4 and g.expand(g.symbols).tolist() == ids.tolist()
    assert g.lengths.tolist() == [len(g.expand(np.array([256 + k]))) for k in range(len(g.rules))]


def brute_spans(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@pytest.mark.parametrize(("window", "seed"), [(35, 20), (8, 5), (12, 6)])
def test_substrings(odd, none, window, seed):
    rows = inputs(odd)
    expected = [(i, *x) for (i, _), x in zip(rows, brute_spans([t for _, t in rows], window))]
    assert table(substring_dedup.duplicate_spans(odd, window, seed), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    assert substring_dedup.duplicate_spans(none, window, seed).count() == 0


def test_factors(spark):
    """A copied passage is one factor, with the place of its reference; of two references that meet, two factors."""
    word = lambda head, n: " ".join(f"{head}{i}" for i in range(n))
    a, b = word("a", 80), word("b", 60)
    texts = [f"x1 x2 {a} x3", f"y1 {b} y2", f"z1 {a} z2 {b}", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    th = {r["t"]: r["th"] for r in docs.selectExpr("text AS t", "xxhash64(text) AS th").collect()}
    got = sorted(tuple(r) for r in substring_dedup.factors(docs).select("th", "start", "length", "ref", "ref_start").collect())
    place = {0: [(2, 80, "a")], 1: [(1, 60, "b")], 2: [(1, 80, "a"), (82, 60, "b")]}
    held = {"a": {0: 2, 2: 1}, "b": {1: 1, 2: 82}}
    first = {k: min(own, key=lambda i: th[texts[i]]) for k, own in held.items()}
    assert got == sorted((th[texts[i]], start, length, th[texts[first[k]]] >> substring_dedup.ROOM, held[k][first[k]]) for i, own in place.items() for start, length, k in own)


def test_language(odd, none, spark):
    net = language_id.train(odd)
    rows = language_id.predict(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "und") for r in rows)
    letters = {i: bool(t and re.search(r"[^\W\d_]", t)) for i, t in inputs(odd)}
    assert all((r["lang_pred"] == "und") == (not letters[r["doc_id"]]) for r in rows)
    assert language_id.train(none) is None
    assert language_id.predict(none, net).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    kept = language_id.keep_known(odd, None, 0.4)
    assert kept.columns == odd.columns and kept.count() == sum(letters[i] for i, _ in inputs(odd))


def test_network_reads_texts_byte_by_byte(odd_texts):
    net = language_id.Network(["a", "b", "c"]).freeze()
    texts = [(t or "").encode() for t in odd_texts] + [bytes(range(256)) * 5, b"x" * 383, b"y" * 384, b"z" * 385, b"w" * 513]
    sums = net.sums(texts)
    for t, own in zip(texts, sums):
        if len(t) < 3000:
            mean = own / max(1, len(t))
            share = np.exp(mean) / np.exp(mean).sum()
            assert np.allclose(share, reads(net, t) if t else 1 / 3, atol=1e-5)
    assert np.allclose(net.sums(texts[::-1])[::-1], sums, rtol=1e-4, atol=1e-3)  # alone or in any company


def test_language_sample_is_bounded(spark):
    """Rows of one doc_id train each with its own lang, repeated rows once, and never more than the bound reaches the driver."""
    rows = [(1, f"text number {i}", "en" if i % 2 else "fr") for i in range(400)] + [(3, "again " * 5000, "de")] * 60 + [(1, "no language", None), (None, "no id", "en"), (3, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, 50, 1000).collect()
    assert Counter(r["language"] for r in got) == {"en": 50, "fr": 50, "de": 1}
    assert all(len(r["windows"]) <= language_id.WINDOWS * language_id.LENGTH for r in got)
    assert len(language_id.sample(docs, 50, 7).collect()) == 7
    right = {f"text number {i}": "en" if i % 2 else "fr" for i in range(400)}
    assert all(right[bytes(r["windows"]).decode()] == r["language"] for r in got if r["language"] != "de")


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], 4, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, lang = rng.integers(97, 105, (6, 5)), np.arange(6) % 3
    rows[2, 3:] = language_id.OUTSIDE
    _, g = net.step(rows, lang)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old, e = v[at], 1e-4  # states are in single precision
        v[at] = old + e
        up, _ = net.step(rows, lang)
        v[at] = old - e
        down, _ = net.step(rows, lang)
        v[at] = old
        assert abs(g[k][at] - (up - down) / 2 / e) < 2e-4 + 1e-2 * abs(g[k][at])


def test_simhash(odd, none):
    rows = inputs(odd)
    prints, links, least, root = near(rows)
    expected = [(i, prints[k] - (1 << 64) * (prints[k] >> 63), links[k], least[k]) for k, (i, _) in enumerate(rows)]
    assert table(simhash.near_duplicates(odd), "doc_id", "fp", "n_near", "component_id") == sorted(expected, key=repr)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root))
    expected = {x for x in near(rows, 2, 3)[2] if x is not None}
    assert {r["doc_id"] for r in simhash.keep_one(odd, size=2, count=3).collect()} - {None} == expected
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components_without_ids_stay_apart(spark):
    docs = spark.createDataFrame([(None, "one text of five words"), (None, "another text that is quite different from it"), (None, "one text of five words"), (4, "third")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == ["another text that is quite different from it", "one text of five words", "third"]


def test_anchors_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    values = {int(v) for v in base}
    for v in base:
        for k in (1, 2, 3, 4):
            for _ in range(6):
                x = int(v)
                for b in rng.choice(64, k, replace=False):
                    x ^= 1 << int(b)
                values.add(x)
    values = sorted(v - (1 << 64) * (v >> 63) for v in values)
    pairs = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    expected = {(x, y) for a, x in enumerate(values) for y in values[a + 1 :] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}
    assert len(pairs) == len(expected) and set(map(tuple, pairs)) == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (150, 200), (150, 300)]
    roots = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert {roots.get(i, i) for i in range(41)} == {0} and {roots.get(i, i) for i in (100, 150, 200, 300)} == {100}


def test_components_of_few_edges_take_few_jobs(spark):
    """Every stage costs the driver memory until its garbage is collected."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    spark.sparkContext.setJobGroup("few edges", "components")
    try:
        assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 5


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(int(x), int(y)) for x, y in rng.integers(-(1 << 62), 1 << 62, 300)[rng.integers(0, 300, (220, 2))]] + [(5, 5), (9, 8), (8, 9)]
    edges = spark.createDataFrame(pairs, "x long, y long").repartition(4)
    least = {v: v for p in pairs for v in p}
    while any(least[x] != least[y] for x, y in pairs):
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
    expected = {(v, r) for v, r in least.items() if v != r}
    assert {tuple(r) for r in simhash.components(edges).collect()} == expected
    monkeypatch.setattr(simhash, "ONE_TASK", -1)
    assert {tuple(r) for r in simhash.components(edges).collect() if r["fp"] != r["root"]} == expected
    assert simhash.components(edges.limit(0)).count() == 0


def test_lines(odd, none):
    rows = inputs(odd)
    expected = [(i, t) for (i, _), t in zip(rows, without_lines(rows, 4))]
    out = line_dedup.drop_recurring(odd, 4)
    assert out.columns == odd.columns
    assert table(out, "doc_id", "text") == sorted(expected, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert line_dedup.drop_recurring(none).count() == 0
    assert {r["template"] for r in line_dedup.recurring(odd, 12).collect()} >= {"All rights reserved <*>"}


def test_leaves_generalise(spark):
    """A variable word at any place beyond the leading two, short or long lines; leading tokens, and lines that vary more, stay apart."""
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klm"]
    rows = [(k, f"posted to {n} as news\npage {k} of {k + 9}\nwritten by {n} {n}x\n{n} was here again\n{k}\nall rights belong to {n} and {n} of this fine old company") for k, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["template"]: r["n_docs"] for r in line_dedup.recurring(docs).collect()}
    assert found == {"posted to <*> as news": 30, "page <*> of <*>": 30, "all rights belong to <*> and <*> of this fine old company": 30}
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(docs).collect()}
    assert out[0] == rows[0][1] and all(out[k] == f"written by {n} {n}x\n{n} was here again\n{k}" for k, n in enumerate(names) if k)
    assert line_dedup.drop_recurring(docs, 31).orderBy("doc_id").collect() == docs.orderBy("doc_id").collect()


def test_decontamination(odd, none, spark, odd_texts):
    item = "the quick brown fox jumps over one lazy dog while nine other small dogs sleep in sun"
    w = item.split()
    docs = spark.createDataFrame(
        [(1, f"x y {item} z"), (2, " ".join(w[8:] + ["zz"] + w[:8])), (3, " ".join(w[::-1])), (4, item.upper().replace(" ", ", ")), (5, " ".join(w[:6])), (6, None), (7, ""), (8, "tiny item")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlaps(docs, items).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2, 4, 8}
    assert (got[1]["item_id"], got[1]["covered"], got[1]["longest"], got[1]["n_items"]) == (1, 17, 17, 2)
    assert got[2]["covered"] == 17 and got[2]["longest"] == 9 and got[5]["covered"] == 6
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 5, 6, 7]
    items_sorted = sorted((r["item_id"], r["text"]) for r in items.collect())
    for r in docs.collect():
        assert tuple(got[r["doc_id"]][n] for n in ("n_items", "item_id", "item_tokens", "covered", "longest")) == overlap(r["text"], items_sorted)
    old = decontaminate.blocks
    try:  # one item a block gives the same
        decontaminate.blocks = lambda b: old(b, 1)
        again = {r["doc_id"]: r for r in decontaminate.overlaps(docs, items).collect()}
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 5, 6, 7]
    finally:
        decontaminate.blocks = old
    names = ["n_items", "item_id", "item_tokens", "covered", "longest", "contaminated"]
    assert {i: [r[n] for n in names] for i, r in got.items()} == {i: [r[n] for n in names] for i, r in again.items()}
    assert decontaminate.overlaps(odd, items).count() == odd.count() and decontaminate.overlaps(odd, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.drop_contaminated(odd, items).columns == odd.columns


def test_tiles_are_greedy():
    tile = lambda p, t, least: decontaminate.tile(np.frombuffer(p.encode(), np.uint8).astype(np.uint64), np.frombuffer(t.encode(), np.uint8).astype(np.uint64), least)
    assert tile("abcdexyzfghij", "fghijabcde", 5) == [(0, 5, 5), (8, 0, 5)]
    assert tile("aaaa", "aaaaaaaa", 2) == [(0, 0, 4)]
    assert tile("abc", "", 2) == tile("", "abc", 2) == tile("abc", "xyz", 2) == []
    rng = random.Random(2)
    for _ in range(150):
        p, t = ("".join(rng.choices("ab" if rng.random() < 0.5 else "abcdefg", k=rng.randint(1, 40))) for _ in range(2))
        assert [k for _, _, k in tile(p, t, 3)] == tiles(list(p), list(t), 3)


def test_a_document_of_one_seed_again_and_again(spark):
    """Two hundred thousand places of one seed take seconds."""
    item = "a b c d e a b c d e f g h i j k"
    block = decontaminate.Block([(1, item)])
    begun = time.process_time()
    assert block.find(["a b c d e " * 40_000 + "x f g h i j k"]) == [(0, 1, 16, 16, 10)]
    assert time.process_time() - begun < 20
