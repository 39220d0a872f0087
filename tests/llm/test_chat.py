"""Templates, trees and odd rows of conversations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat

TEXT = st.text(alphabet=st.sampled_from(list("\\#</turn>: aÄ\nAssistant")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "User", "a:b"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    text = chat.formatted(turns)
    got = chat.parsed(text)
    assert [(r, t) for r, t, _, _ in got] == turns
    assert [chat.unescape(text[a:b]) for _, _, a, b in got] == [t for _, t in turns]


def test_no_turn():
    with pytest.raises(ValueError):
        chat.parsed("plain")


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, None, "b"), (1, 1, "assistant", "a"), (None, 3, "user", "x"), (2, None, "user", ""), (2, 5, "assistant", "long " * 5000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, place int")
    out = {r["conv_id"]: r["formatted"] for r in chat.conversations(chat.best_paths(chat.chain(df))).collect()}
    assert [(r, t) for r, t, _, _ in chat.parsed(out[1])] == [("user", ""), ("", "b"), ("", "b"), ("assistant", "a")]
    assert [(r, t) for r, t, _, _ in chat.parsed(out[None])] == [("user", "x")]
    assert [(r, t) for r, t, _, _ in chat.parsed(out[2])] == [("user", ""), ("assistant", "long " * 5000)]
    assert chat.digests(chat.conversations(chat.best_paths(chat.chain(df.limit(0))))).count() == 0


def test_branches(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 0.0), (1, 4, 3, "user", "why", 1.0), (1, 5, 2, "user", "thanks", 5.0), (1, 5, 2, "user", "zz", 5.0),
        (1, 8, 9, "user", "loop", 9.0), (1, 9, 8, "user", "loop", 9.0), (1, 11, 77, "user", "orphan", 9.0), (2, 1, None, "user", "alone", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    got = sorted((r["conv_id"], r["branch"], r["place"], r["text"]) for r in chat.best_paths(df, 2).collect())
    assert got == [(1, 1, 0, "q"), (1, 1, 1, "good"), (1, 1, 2, "thanks"), (1, 2, 0, "q"), (1, 2, 1, "bad"), (1, 2, 2, "why"), (2, 1, 0, "alone")]
