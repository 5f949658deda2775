import random
import warnings

import pytest
from helpers import conversation, conversations, label, label_sets, turn

from colloquy.llm import consensus
from colloquy.llm.consensus import _Pattern, _unpack, fit_consensus, items, votes


def world(n=60, seed=1):
    rng = random.Random(seed)
    people, convs, golds, truth = ["A", "B", "C", "D"], [], [], {}
    rates = {"good1": 0.93, "good2": 0.9, "good3": 0.88, "poor": 0.45, "lazy": None}
    for c in range(n):
        turns, labels = [], []
        for t in range(10):
            speaker = rng.choice(people)
            turns.append(turn(t, speaker, float(t), t + 0.8, "text"))
            others = [p for p in people if p != speaker]
            true = "GROUP" if rng.random() < 0.2 else rng.choice(others)
            truth[f"c{c}", t] = true
            for who in rng.sample(list(rates), 3 + (c % 3)):
                answer = "GROUP" if rates[who] is None else true if rng.random() < rates[who] else rng.choice([x for x in [*others, "GROUP"] if x != true])
                labels.append(label(t, [answer + " "], rng.choice([0.5, None, 80.0]), rng.choice([who, who.upper(), who + " "])))
        convs.append(conversation(f"c{c}", turns, people))
        golds.append((f"c{c}", labels))
    return convs, golds, truth


def test_beats_the_majority_and_ranks_labelers(spark):
    convs, golds, truth = world()
    model = fit_consensus(label_sets(spark, golds), conversations(spark, convs), iterations=8)
    got = {(r.conversation_id, r.turn_id): r for r in model.labels().collect()}
    assert set(got) == set(truth)
    right = sum(r.addressees == truth[k] for k, r in got.items()) / len(truth)
    counts = {}
    for c, labels in golds:
        for x in labels:
            counts.setdefault((c, x["turn_id"]), []).append(x["addressees"][0].strip())
    majority = sum(max(sorted(set(v)), key=v.count) == truth[k] for k, v in counts.items()) / len(truth)
    assert right > 0.85 and right > majority
    assert all(0 <= r.agreement <= 1 and 0 < r.probability <= 1 and r.n_voters == len(counts[k]) for k, r in got.items())
    reliability = {r.labeler: r.reliability for r in model.labelers().collect()}
    assert min(reliability[f"good{k}"] for k in (1, 2, 3)) > 0.75 > reliability["poor"] > reliability["lazy"]


def test_votes_that_do_not_count(spark):
    rows = conversations(spark, [conversation("c", [turn(0, "A"), turn(1, "B")], ["A", "B", "C"])])
    gold = [
        ("c", [label(0, ["C", "B", " B"], labeler="x"), label(0, ["B", "C"], labeler="y"), label(0, ["C", "B", None, ""], labeler=" Z "), label(0, ["B"], labeler=None), label(0, ["B"], labeler=" "),
               label(0, ["A"], labeler="self"), label(0, ["UNKNOWN", "B"], labeler="u"), label(0, [], labeler="e"), label(0, None, labeler="n"), label(0, ["B", "C"], labeler="X")]),
        ("c", [label(0, ["B", "C"], labeler="x")]),
        ("gone", [label(0, ["P"], labeler=w) for w in "xyz"]),
        ("empty", []),
    ]
    model = fit_consensus(label_sets(spark, gold), rows, iterations=3)
    got = {(r.conversation_id, r.turn_id): (r.addressees, r.n_voters) for r in model.labels(3).collect()}
    assert got == {("c", 0): ("B+C", 3), ("gone", 0): ("P", 3)}
    assert model.labels(4).count() == 0


def test_empty(spark):
    model = fit_consensus(label_sets(spark, []), conversations(spark, []), iterations=2)
    assert model.labels().count() == 0 and model.labelers().count() == 0


def test_confidence_counts_as_far_as_it_means_something(spark):
    rng = random.Random(4)
    people, convs, golds, truth = ["A", "B", "C", "D"], [], [], {}
    for c in range(60):
        turns, labels = [], []
        for t in range(10):
            turns.append(turn(t, "A", float(t), t + 0.8, "text"))
            truth[f"c{c}", t] = true = rng.choice(people[1:])
            for who in ("one", "two", "three", "boaster"):
                sure = rng.random() < 0.5
                right = rng.random() < (0.95 if sure else 0.35) if who != "boaster" else rng.random() < 0.4
                answer = true if right else rng.choice([p for p in people[1:] if p != true])
                confidence = 0.95 if sure or who == "boaster" else 0.6
                labels.append(label(t, [answer], rng.choice([confidence, 100 * confidence]), who))
        convs.append(conversation(f"c{c}", turns, people))
        golds.append((f"c{c}", labels))
    model = fit_consensus(label_sets(spark, golds), conversations(spark, convs))
    right = sum(r.addressees == truth[r.conversation_id, r.turn_id] for r in model.labels().collect()) / len(truth)
    assert right > 0.85
    sure, doubtful, boast = (model.theta[k][1, 0] for k in ("one\x023", "one\x021", "boaster\x023"))
    assert sure > 0.85 and doubtful < 0.55 and boast < 0.55
    assert {r.labeler for r in model.labelers().collect()} == {"one", "two", "three", "boaster"}


def test_too_many_labelers_are_refused_before_they_are_read(spark, monkeypatch):
    convs, golds, _ = world(4)
    monkeypatch.setattr(consensus, "MOST_LABELERS", 4)
    with pytest.raises(ValueError, match="5 labelers"):
        fit_consensus(label_sets(spark, golds), conversations(spark, convs))


def test_settles_and_corrects_for_chance(spark):
    convs, golds, truth = world()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        model = fit_consensus(label_sets(spark, golds), conversations(spark, convs))
        assert model.settled and not [w for w in said if "settled" in str(w.message)]
        fit_consensus(label_sets(spark, golds), conversations(spark, convs), iterations=2)
        assert [w for w in said if "had not settled" in str(w.message)]
    rows = model.labels().collect()
    assert all(0 < r.agreement_by_chance < 1 and r.corrected <= r.agreement for r in rows)
    assert all(abs(r.corrected - 1) < 1e-9 for r in rows if r.agreement == 1)


def test_long_texts_may_be_backchannels(spark):
    """One short word in a long text of another script counts as it does in the evaluation."""
    rows = conversations(spark, [conversation("c", [turn(0, "A", text="ok " + "。" * 200), turn(1, "B", text="well " * 60)], ["A", "B"])])
    gold = label_sets(spark, [("c", [label(t, ["GROUP"], labeler=w) for t in (0, 1) for w in "xyz"])])
    assert [r.backchannel for r in items(gold, rows).orderBy("turn_id").collect()] == [True, False]


def test_grades_of_confidence(spark):
    values = [None, float("nan"), -1.0, 101.0, 0.0, 0.75, 75.0, 0.76, 90.0, 0.91, 1.0, 100.0]
    gold = label_sets(spark, [("c", [label(t, ["B"], v) for t, v in enumerate(values)])])
    assert [r.grade for r in votes(gold).orderBy("turn_id").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 3]


@pytest.mark.parametrize("others", [3, 5, 6, 12])
def test_candidates_do_not_hang_on_the_size_of_the_roster(others):
    masks = _Pattern(others, (0b001, 0b010, 0b101)).masks
    assert {0, 0b001, 0b011, 0b101, 0b110, 0b111} <= set(masks) and len(masks) == len(set(masks))
    assert {0b1100, 0b1111} <= set(_Pattern(others + 1, (0b0111, 0b1100)).masks)
    assert 0b110000 in _Pattern(others + 6, (0b1,), 0b110000).masks


def test_candidates_grow_with_the_roster_not_with_its_cube():
    n = [len(_Pattern(k, (0b01, 0b10), 0b111).masks) for k in (10, 20, 40)]
    assert n[2] - n[1] == 2 * (n[1] - n[0]) and n[2] < 300


def test_a_set_that_nobody_voted_for_in_a_large_roster(spark):
    people = ["S", *"ABCDEFG"]
    convs = [conversation("c", [turn(t, "S", float(t), t + 0.5, "text") for t in range(8)], people)]
    gold = [("c", [label(t, names, labeler=who) for t in range(8) for who, names in (("x", ["A"]), ("y", ["B"]), ("z", ["A", "C"]))])]
    blocks = fit_consensus(label_sets(spark, gold), conversations(spark, convs), iterations=1).blocks.collect()
    assert "A+B" in _unpack(blocks[0].data).candidates
