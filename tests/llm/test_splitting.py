import random

import pytest
from helpers import conversation, conversations, turn
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.splitting import atoms, pieces, sentences, split_texts, split_turns


def check(text, limit, overlap):
    spans, cut = pieces(text, limit, overlap)
    covered, previous = set(), -1
    for k, (a, b, shared) in enumerate(spans):
        assert 0 < b - a <= limit and 0 <= shared <= overlap and (k or not shared)
        assert a + shared > previous and text[a : a + shared] == text[a : a + shared]
        covered.update(range(a, b))
        previous = a + shared
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    longest = max((b - a for a, b in sentences(text)), default=0)
    run = max((len(w) for a, b in sentences(text) if b - a > limit for w in text[a:b].split()), default=0)
    assert cut == ("sentence" if longest <= limit else "space" if run <= limit else "hard")
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?…\n\"'”。！」  ", max_size=400), st.sampled_from([(20, 5), (30, 0), (64, 8)]))
def test_properties(text, sizes):
    check(text, *sizes)


def test_kinds():
    assert atoms("a" * 512)[2] == "sentence" and atoms("a" * 513)[2] == "hard" and atoms("a " * 300)[2] == "space"
    assert list(sentences('He said "no." Then 3.5 more。」好！x')) == [(0, 13), (14, 29), (29, 31), (31, 32)]
    assert check("First one here. " * 60, 100, 20)[1][2] > 0
    assert check("", 10, 2) == check("   \n ", 10, 2) == []


def test_weak_boundaries_go_first():
    text = "aaaa bbbb.\n\ncccc dddd. eeee ffff."
    assert [text[a:b] for a, b, _ in pieces(text, 22, 0)[0]] == ["aaaa bbbb.", "cccc dddd. eeee ffff."]


def test_long_text_is_quick():
    rng = random.Random(2)
    text = " ".join("x" * rng.randint(1, 9) + ("." if rng.random() < 0.1 else "") for _ in range(60_000))
    check(text, 512, 64)


def test_frames(spark):
    rows = [(1, "x" * 513, 7), (2, None, 7), (3, "", 7), (4, "y" * 512, 7), (1, "x" * 513, 7)]
    got = split_texts(spark.createDataFrame(rows, "id int, text string, cut int")).collect()
    assert [(r.id, r.cut, len(r.pieces)) for r in got] == [(1, "hard", 2)] * 2
    turns = [turn(0, text="word " * 200), turn(0, text="word " * 200), turn(0, text="Word. " * 200), turn(1, text=None), turn(2, text="short")]
    found = split_turns(conversations(spark, [conversation("c", turns), conversation("c", [turn(5, text="z" * 600)], revision="0"), conversation("d", None)]))
    assert sorted((r.conversation_id, r.turn_id, r.cut) for r in found.collect()) == [("c", 0, "sentence"), ("c", 0, "space")]
    assert split_turns(conversations(spark, [])).count() == 0


def test_hard_pieces_overlap_too():
    text = "x" * 2000
    got, cut = pieces(text, 512, 64)
    assert cut == "hard" and all(b - a <= 512 for a, b, _ in got) and [s for *_, s in got] == [0] + [64] * (len(got) - 1)
    assert got[0][0] == 0 and got[-1][1] == 2000
