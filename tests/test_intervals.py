import random

from helpers import conversation, conversations, tuples, turn

from colloquy.operators.intervals import gaps_between, merged_periods, speech_periods_and_gaps


def brute(intervals):
    runs = []
    for a, b in sorted(intervals):
        if runs and a <= runs[-1][1]:
            runs[-1][1], runs[-1][2] = max(runs[-1][1], b), runs[-1][2] + 1
        else:
            runs.append([a, b, 1])
    return [tuple(r) for r in runs]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 5)}", a := rng.randint(0, 60), a + rng.randint(1, 8)) for _ in range(150)]
    rows += [rows[0], rows[1]]  # repeated intervals
    got = tuples(merged_periods(spark.createDataFrame(rows, "k string, start_ms bigint, end_ms bigint"), "k"))
    expected = sorted(((k, *r) for k in {r[0] for r in rows} for r in brute([(a, b) for x, a, b in rows if x == k])), key=repr)
    assert got == expected


def test_slices_of_time_change_nothing(spark):
    rng = random.Random(2)
    rows = [("k", a := rng.randint(-300, 300), a + rng.choice([1, 2, 5, 90])) for _ in range(60)]
    frame = spark.createDataFrame(rows, "k string, start_ms bigint, end_ms bigint")
    expected = sorted((("k", *r) for r in brute([(a, b) for _, a, b in rows])), key=repr)
    assert all(tuples(merged_periods(frame, "k", slice_ms=s)) == expected for s in (1, 10, 100_000))


def test_touching_nested_nulls_and_ties(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 12, 15), ("a", 30, 40), ("a", None, 5), ("a", 5, None), ("a", 7, 7), ("a", 9, 3), (None, 1, 2), (None, 2, 3)]
    periods = merged_periods(spark.createDataFrame(rows, "k string, start_ms bigint, end_ms bigint"), "k")
    assert tuples(periods) == sorted([("a", 0, 20, 3), ("a", 30, 40, 1), (None, 1, 3, 2)], key=repr)
    assert tuples(gaps_between(periods, "k", 10)) == [("a", 20, 30)]
    assert tuples(gaps_between(periods, "k", 11)) == []


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, start_ms bigint, end_ms bigint")
    assert tuples(merged_periods(empty, "k")) == []
    more = spark.createDataFrame([("a", 0, 5, 9, "x")], "k string, start_ms bigint, end_ms bigint, n int, `__run` string")
    assert tuples(merged_periods(more, "k")) == [("a", 0, 5, 1)]


def test_conversations(spark):
    turns = [turn(0, "A", 0.0, 2.0), turn(0, "A", 0.0, 2.0), turn(1, "B", 1.5, 3.0), turn(2, "A", 5.0, 6.0), turn(3, "B", 6.0, 6.0), turn(4, None, None, 9.0), turn(5, "A", 7.999, 8.5)]
    rows = [
        conversation("c", [turn(0, "A", 0.0, 100.0)], revision="9"),
        conversation("c", turns, revision="10"),
        conversation("c", turns, revision="10"),
        conversation("none", None),
        conversation("nothing", []),
        conversation("norevision", [turn(0, "A", 1.0, 2.0), turn(1, "A", 1.0, 2.0)], revision=None),
        conversation("nan", [turn(0, "A", float("nan"), 2.0), turn(1, "A", 0.0, float("inf"))]),
    ]
    got = tuples(speech_periods_and_gaps(conversations(spark, rows)))
    assert got == [("c", "gap", 3000, 5000), ("c", "period", 0, 3000), ("norevision", "period", 1000, 2000)]
    assert tuples(speech_periods_and_gaps(conversations(spark, []))) == []


def test_one_shuffle(spark):
    rows = conversations(spark, [conversation("c", [turn(0)])])
    plan = speech_periods_and_gaps(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
