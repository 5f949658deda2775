import random

from helpers import conversation, conversations, tuples, turn

from colloquy.llm import nearest
from colloquy.llm.nearest import clip_turn_partners, nearest_in_time

LEFT, RIGHT = "e string, t bigint, id int", "e string, t bigint, p bigint"


def brute(left, right, tolerance):
    out = []
    for e, t, i in left:
        near = [(abs(rt - t), rt, p) for re, rt, p in right if None not in (e, t, re, rt) and re == e and abs(rt - t) <= tolerance]
        if near:
            out.append((e, t, i, min(near)[2]))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    for seed, tolerance in ((1, 7), (2, 0), (3, 1000), (4, 8)):
        rng = random.Random(seed)
        left = [(f"e{rng.randint(0, 3)}", rng.randint(-200, 200), i) for i in range(200)]
        right = [(f"e{rng.randint(0, 3)}", rng.randint(-200, 200), i) for i in range(80)]
        got = tuples(nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["e"], "t", tolerance, "p"))
        assert got == brute(left, right, tolerance)


def test_neighbours_across_the_edges_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(nearest, "STRETCH", 1)
    test_against_brute_force(spark)


def test_ties_nulls_repeats_empty(spark):
    left = [("a", 10, 1), ("a", 10, 1), ("a", None, 2), (None, 10, 3), ("b", 10, 4)]
    right = [("a", 8, 5), ("a", 12, 4), ("a", 8, 3), ("a", 8, 3), ("a", None, 1), (None, 10, 1)]
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert tuples(nearest_in_time(l, r, ["e"], "t", 5, "p")) == [("a", 10, 1, 3), ("a", 10, 1, 3)]
    assert tuples(nearest_in_time(l.limit(0), r, ["e"], "t", 5, "p")) == tuples(nearest_in_time(l, r.limit(0), ["e"], "t", 5, "p")) == []
    more = l.selectExpr("*", "1 AS __low", "2 AS `odd name`", "3 AS bucket")
    assert [x[:3] for x in tuples(nearest_in_time(more.drop("__low"), r, ["e"], "t", 5, "p"))] == [("a", 10, 1)] * 2


def test_clips(spark):
    ours = [conversation("M", [turn(7, " Ann ", 10.0), turn(3, "ANN", 11.5), turn(2, "ann", 11.5), turn(1, None, 10.0), turn(4, "Bob", None)])]
    clips = [
        conversation("M_t0010-0020", [turn(0, "ann", 0.75), turn(1, "Ann", 0.751), turn(2, "Ann ", 3.0), turn(3, None, 0.0), turn(4, "Ann", None), turn(0, "ann", 0.75)]),
        conversation("M_t0010-0020", [turn(0, "ann", 0.75), turn(1, "Ann", 0.751), turn(2, "Ann ", 3.0), turn(3, None, 0.0), turn(4, "Ann", None), turn(0, "ann", 0.75)]),
        conversation("x", [turn(0, "ann", 10.0)], meeting="M"),
        conversation("y", [turn(0, "ann", 9.0)], meeting="M", t0="1"),
        conversation("z", [turn(0, "ann", 9.0)], meeting="M", t0="not a number"),
        conversation("w", [turn(0, "ann", 2.0)]),
        conversation("nobody", None),
    ]
    meta = spark.createDataFrame([("w", 8.0, "M"), ("w", 8.0, "M"), ("y", None, None)], "conversation_id string, clip_t0_sec double, ami_meeting string")
    got = tuples(clip_turn_partners(conversations(spark, clips), meta, conversations(spark, ours)))
    assert got == [("M_t0010-0020", 0, "M", 7), ("M_t0010-0020", 1, "M", 2), ("w", 0, "M", 7), ("x", 0, "M", 7), ("y", 0, "M", 7)]
