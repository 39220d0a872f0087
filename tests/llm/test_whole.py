"""Jobs that are to be done whole."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import substring_dedup, token_files


def most_places(g):
    """How many places the most frequent pair of a grammar's symbols still has, without places that overlap."""
    seen, bounds = Counter(), np.append(g.starts, len(g.symbols)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        k, pairs = 0, list(zip(g.symbols[a : b - 1].tolist(), g.symbols[a + 1 : b].tolist()))
        while k < len(pairs):
            seen[pairs[k]] += 1
            k += 2 if pairs[k : k + 2] == [pairs[k]] * 2 and pairs[k][0] == pairs[k][1] else 1
    return max(seen.values(), default=0)


def test_repair_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 256, 700)
    docs = [np.concatenate((rng.integers(0, 256, 5), phrase, rng.integers(0, 256, k))) for k in range(20)] + [np.full(99, 7), np.zeros(0, int)]
    starts = np.cumsum([0, *map(len, docs[:-1])])
    ids = np.concatenate(docs).astype(np.uint32)
    g = token_files.repair(ids, starts, 256)
    assert g.expand(g.symbols).tolist() == ids.tolist()
    assert most_places(g) < token_files.LEAST
    assert g.lengths.max() >= 700
    weighted = token_files.repair(np.tile(ids[: starts[1]], 2), np.array([0, starts[1]]), 256, weights=np.array([1, 7]))
    assert weighted.starts.tolist() == [0, 1] and len(weighted.symbols) == 2
    assert weighted.expand(weighted.symbols).tolist() == [*ids[: starts[1]], *ids[: starts[1]]]


def test_shards_hold_phrases_and_copies_once():
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    phrase, copied = " ".join(rng.choice(words, 300)), " ".join(rng.choice(words, 2000))
    texts = [f"{' '.join(rng.choice(words, 30))} {phrase} {k}" for k in range(12)] + [copied] * 40 + [None, ""]
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    first = encoder.library.get_vocab_size()
    g, sizes = token_files.repair_texts(texts, encoder, first)
    assert most_places(g) < token_files.LEAST
    assert np.diff(g.starts)[12:52].tolist() == [1] * 40  # a copied text is one symbol
    wide = token_files.Grammar(first, np.concatenate((g.rules, np.tile(g.rules[:1], (20000, 1)))), np.append(g.lengths, np.full(20000, g.lengths[0])), g.symbols.copy(), g.starts)
    wide.symbols[-1] = first + len(g.rules) + 19999  # beyond 16 bits, as the last copy's only symbol
    for grammar, texts, sizes in ((g, texts, sizes), (wide, texts[:51], np.append(sizes[:51], [g.lengths[0], 0, 0]))):
        reader = token_files.Reader(token_files.to_bytes(grammar, np.arange(54), sizes + 1))
        for k, text in enumerate(texts):
            ids = encoder.library.encode(text or "", add_special_tokens=False).ids
            assert reader.document(k).tolist() == [*ids, token_files.END]
            assert reader.range(k, 150, 190).tolist() == [*ids, token_files.END][150:190]
    assert reader.document(51).tolist() == [*g.expand(g.rules[0]), token_files.END]


def test_texts_of_one_doc_id_whose_short_hashes_agree(spark):
    """Each text keeps its own places, though 32 bits of hash can't tell the texts apart."""
    passage, other = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40))
    many = lambda head, name: spark.range(200_000).select(F.concat(F.lit(head), F.lit(" "), F.col("id").cast("string")).alias(name), F.hash(F.concat(F.lit(head), F.lit(" "), F.col("id").cast("string"))).alias("h"))
    a, b = many(passage, "a").join(many(other, "b"), "h").select("a", "b").orderBy("a").first()
    docs = spark.createDataFrame([(None, a), (None, b), (5, f"x {passage} y")], "doc_id long, text string")
    rows = substring_dedup.duplicate_spans(docs).select("doc_id", "n_words", "n_removed", F.col("kept").cast("string")).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(None, 41, 40, a.split()[-1]), (None, 41, 0, b), (5, 42, 40, "x y")], key=repr)
