from helpers import conversation, conversations, tuples, turn
from pyspark.sql import functions as F

from colloquy.operators import heuristic, labeling, merge, windows
from colloquy.operators.current import current_turns
from colloquy.operators.overlap import overlap_flags


def turns_of(spark, n=10, **more):
    return current_turns(conversations(spark, [conversation("c", [turn(i, "AB"[i % 2], float(i), i + 0.5, f"t{i}") for i in range(n)], **more)]))


def test_tiles(spark):
    rows = windows.tiles(turns_of(spark), 4, 2).orderBy("window_id", "position").collect()
    context = {w: [r.turn_id for r in rows if r.window_id == w and r.role == "CTX"] for w in range(3)}
    assert context == {0: [], 1: [2, 3], 2: [6, 7]}
    assert sorted(r.turn_id for r in rows if r.role == "TARGET") == list(range(10))
    assert windows.tiles(turns_of(spark), 0, 0).where("role = 'TARGET'").count() == 10
    assert windows.tiles(turns_of(spark), 2, 5).where("window_id = 4 AND role = 'CTX'").count() == 5
    assert windows.tiles(current_turns(conversations(spark, [])), 4, 2).count() == 0


def test_render_and_span(spark):
    tiled = windows.tiles(turns_of(spark, 3), 2, 1)
    rosters = spark.createDataFrame([("c", ["A", "B"])], "conversation_id string, speakers array<string>")
    text = windows.render(tiled, rosters).where("window_id = 1").first().text.split("\n")
    assert text[0] == "Speakers in this conversation: A, B" and text[-2:] == ["[CTX] (turn 1) [1.00-1.50] B: t1", "[>> ] (turn 2) [2.00-2.50] A: t2"]
    assert tuples(windows.time_spans(tiled)) == [("c", 0, 0.0, 1.5), ("c", 1, 2.0, 2.5)]


def test_heuristic(spark):
    rows = conversations(spark, [
        conversation("three", [turn(0, "Alice", 0.0, 1.0, "bob, are you in?"), turn(1, "Bob", 1.0, 2.0, "Yes"), turn(2, "Bob", 2.0, 3.0, "Bobby's here"), turn(3, "Carol", 3.0, 4.0, None)], ["Alice", "Bob", "Carol"]),
        conversation("alone", [turn(0, "Alice")], ["Alice"]),
        conversation("first", [turn(0, "Alice", text="hm")], ["Alice", "Bob", "Carol"]),
        conversation("pair", [turn(0, "Alice", text="hm")], ["Alice", "Bob"]),
    ])
    rosters = rows.select("conversation_id", "speakers")
    got = {(r.conversation_id, r.turn_id): r.addressees for r in heuristic.heuristic_labels(current_turns(rows), rosters).collect()}
    assert got == {("three", 0): ["Bob"], ("three", 1): ["Alice"], ("three", 2): ["Alice"], ("three", 3): ["Bob"], ("alone", 0): ["UNKNOWN"], ("first", 0): ["GROUP"], ("pair", 0): ["Bob"]}
    noisy = heuristic.heuristic_labels(current_turns(rows), rosters, noise=1.0, seed=3)
    assert tuples(noisy.select("conversation_id", "turn_id", F.array_join("addressees", "+"))) == tuples(noisy.select("conversation_id", "turn_id", F.array_join("addressees", "+")))


def test_overlap(spark):
    rows = [("m", 0, "A", 0.0, 2.0), ("m", 1, "B", 2.0, 4.0), ("m", 2, "A", 3.0, 3.5), ("m", 3, "A", 3.2, 3.4), ("m", 4, "C", 100.0, 400.0), ("m", 5, "B", 390.0, 391.0), ("m", 6, None, 3.0, 4.0), ("m", 7, "D", None, 4.0),
            ("m", 8, "E", 9000.0, 1e12), ("m", 9, "F", 1e9, 1e9 + 1), ("m", 10, "A", 5000.0, 5400.0), ("m", 11, "B", 5390.0, 5391.0), ("m", 12, "C", 7000.0, 7000.5), ("n", 8, "G", 9100.0, 9200.0)]
    turns = spark.createDataFrame(rows, "conversation_id string, turn_id bigint, speaker string, t_start double, t_end double")
    got = {(r.conversation_id, r.turn_id): r.overlapped for r in overlap_flags(turns).collect()}
    brute = {(m, i): any(o[2] is not None and s is not None and o[2] != s and o[0] == m and None not in (a, b, o[3], o[4]) and o[3] < b and o[4] > a for o in rows) for m, i, s, a, b in rows}
    assert got == brute and sum(got.values()) == 9


def test_merge(spark):
    rows = conversations(spark, [conversation("c", [turn(i, "AB"[i], float(i), i + 0.5, f"t{i}") for i in range(2)], ["A"], note="n"), conversation("empty", [], ["X"]), conversation("none", None)])
    turns = current_turns(rows)
    labels = spark.createDataFrame([("c", 0, ["B"], 0.5, "r")], "conversation_id string, turn_id bigint, addressees array<string>, confidence double, rationale string")
    assert merge.transcripts(turns, labels).first().text == "[   0.00-   0.50]   A -> B         : t0\n[   1.00-   1.50]   B -> ?         : t1"
    merged = {r.conversation_id: r for r in merge.merged_conversations(rows, labels).collect()}
    assert set(merged) == {"c", "empty", "none"} and merged["empty"].turns == merged["none"].turns == [] and merged["c"].meta["note"] == "n" and merged["c"].speakers == ["A"]
    nested = merged["c"].turns
    assert [t.turn_id for t in nested] == [0, 1] and nested[1].addressees is None
    assert tuples(merge.coverage(turns, labels)) == [(2, 1)]


def test_resume(spark):
    tiled = windows.tiles(turns_of(spark), 4, 2)
    done = spark.createDataFrame([("c", i, "m(failed)" if i < 4 else "m") for i in (0, 1, 2, 3, 4)], "conversation_id string, turn_id bigint, labeler string")
    left = lambda **k: sorted({r.window_id for r in labeling.remaining_windows(tiled, done, **k).collect()})
    assert left() == [1, 2] and left(retry_failed=True) == [0, 1, 2]
