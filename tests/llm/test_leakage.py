import random
import time

import numpy as np
from helpers import tuples

from colloquy.llm.leakage import Index, _prefix, chunk_spans, leaked_items, shared_beginnings
from colloquy.llm.words import plain, words

RNG = random.Random(5)
WORDS = ["w" + "".join(RNG.choices("abcdefghij", k=5)) for _ in range(400)]


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def text(rng, n):
    return " ".join(sentence(rng, rng.randint(7, 14)) for _ in range(n))


def test_words_of_other_forms():
    assert words("Ｈéllo WO­RLD &amp; ﬁne​!") == ["hello", "world", "fine"]
    assert words('{"x": "caf\\u00e9\\nnoir"}') == ["x", "cafe", "noir"]
    assert words("[CTX] (turn 3) [1.00-2.50] Ann: yes") == ["ann", "yes"]
    assert words("你好a") == ["你", "好", "a"] and words("") == []
    assert plain("im-\n> port") == "import"


def brute_distance(pattern, text):
    row = best = list(range(len(pattern) + 1))
    low = best[-1]
    for t in text:
        new = [0]
        for i, w in enumerate(pattern):
            new.append(min(row[i] + (w != t), row[i + 1] + 1, new[i] + 1))
        row, low = new, min(low, new[-1])
    return low


def test_distance_against_plain_dynamic_programming():
    rng = random.Random(1)
    index = Index([(i, text(rng, 4)) for i in range(5)])
    numbers = np.array([rng.randint(0, 60) for _ in range(80)])
    chunk = np.repeat(np.arange(len(index.size)), 3)
    low = np.array([rng.randint(0, 50) for _ in chunk])
    high = np.minimum(low + index.size[chunk] + 4, 80)
    got, _ = index.distances(numbers, chunk, low, high)
    for c, a, b, d in zip(chunk, low, high, got):
        assert d == brute_distance(index.words[index.begin[c] : index.begin[c] + index.size[c]].tolist(), numbers[a:b].tolist())


def test_every_chunk_within_its_budget_is_hit():
    """The pigeonhole bound: whatever k errors are made, a piece is hit and the place that it gives leads to the chunk."""
    rng = random.Random(3)
    index = Index([(0, text(rng, 12))])
    for trial in range(300):
        c = rng.randrange(len(index.size))
        w = index.words[index.begin[c] : index.begin[c] + index.size[c]].tolist()
        for _ in range(int(index.budget[c])):
            at, kind = rng.randrange(len(w)), rng.random()
            w[at : at + 1] = [] if kind < 0.33 else [0] if kind < 0.66 else [0, w[at]]
        flat = np.array([0] * 30 + w + [0] * 30)
        _, chunk, start = index.hits(flat, np.zeros(len(flat), int))
        mine = chunk == c
        assert mine.any()
        k = int(index.budget[c])
        distance, _ = index.distances(flat, chunk[mine], start[mine] - k, start[mine] + index.size[c] + k)
        assert distance.min() <= k


def test_small_parts():
    spans = chunk_spans("One two. Three four five six seven. Eight nine ten. " + "w " * 40)
    assert spans[0] == (0, 7) and spans[-1][1] == 50 and all(a == b for (_, a), (b, _) in zip(spans, spans[1:])) and max(b - a for a, b in spans) <= 16
    assert chunk_spans("one two.") == [(0, 2)] and chunk_spans("") == []
    same = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    assert shared_beginnings([(*same, 20, 21), (*same, 30, 31), (*same, 40, 41), (9,) * 12]) == [10, 10, 10, 0]
    assert shared_beginnings([(*same, 20, 21), (*same, 30, 31)]) == [0, 0]
    assert _prefix(np.array([1, 2, 3, 4, 5, 6]), np.array([9, 1, 2, 3, 4]), 2) == 4 and _prefix(np.array([1, 2, 3]), np.array([7, 8, 9]), 1) == 0


def test_an_index_of_many_items_with_one_instruction_is_linear():
    rng = random.Random(4)
    instruction = " ".join(rng.choices(WORDS, k=60)) + ". "
    rows = lambda n: [(i, instruction + " ".join(f"u{i}x{k}" for k in range(60)) + ".") for i in range(n)]
    seconds = []
    for n in (500, 2000):
        began = time.perf_counter()
        index = Index(rows(n))
        seconds.append(time.perf_counter() - began)
        assert {x.shared for x in index.items} == {60}
    assert seconds[1] < 10 * seconds[0] + 1


def test_long_items_have_their_own_pieces():
    """Beyond 65,536 pieces, where a narrow number would spill into another item."""
    long = " ".join(f"a{k}" for k in range(210_000))
    index = Index([(1, long), (2, text(random.Random(6), 6))])
    part = " ".join(f"a{k}" for k in range(60_000, 210_000))
    assert [(index.items[i].ids, n) for _, i, n in index.matches([part])] == [([1], 150_000)]


def test_recall_by_share_of_changed_words():
    """Half of an item, cut anywhere, with a share of its words replaced: what is found."""
    rng = random.Random(8)
    items = [(i, text(rng, rng.randint(6, 14))) for i in range(60)]
    index = Index(items)
    found = {}
    for changed in (0.0, 0.05, 0.1):
        hit = n = 0
        for _, t in items:
            w = words(t)
            size = -(-len(w) * 55 // 100)
            at = rng.randint(0, len(w) - size)
            part = [rng.choice(WORDS) if rng.random() < changed else x for x in w[at : at + size]]
            hit += any(index.items[i].ids == [items[n][0]] for _, i, _ in index.matches([" ".join(rng.choices(WORDS, k=80) + part + rng.choices(WORDS, k=80))]))
            n += 1
        found[changed] = hit / n
    assert found[0.0] >= 0.98 and found[0.05] >= 0.9 and found[0.1] >= 0.6, found


def test_a_leak_inside_one_long_sentence():
    w = [f"s{k}" for k in range(80)]
    index = Index([(7, " ".join(w) + ".")])
    assert list(index.matches([" ".join(["x"] * 30 + w[20:60] + ["y"] * 30)])) and not list(index.matches([" ".join(w[20:45])]))


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    return tuples(leaked_items(d, spark.createDataFrame(items, "item_id bigint, text string")).select("doc_id", "item_id"))


def test_cases(spark):
    rng = random.Random(2)
    instruction = "Read the exchange below and say who is meant by the last of its turns, please."
    item = text(rng, 8)
    parts = item.split(". ")
    other = [instruction + " " + text(rng, 8) for _ in range(4)]
    changed = item.split()
    for k in range(3, len(changed), 9):
        changed[k] = "changed"
    docs = [
        (1, text(rng, 20) + " " + item + " " + text(rng, 20)), (2, item.upper().replace(" ", "\n> ")), (3, " ".join(changed)), (4, ". ".join(parts[:5]) + "."),
        (5, parts[2] + "."), (6, text(rng, 60)), (7, None), (8, ""), (9, instruction), (10, "! ".join(f"{p} and {sentence(rng, 3)}" for p in parts)),
        (11, ". ".join(reversed(parts))), (12, other[0]), (13, text(rng, 3000) + item), (14, ". ".join(parts[-2:])),
    ]
    items = [(100, item), (101, item), (100, item), (102, "short one"), (103, None), (104, " "), *[(200 + k, o) for k, o in enumerate(other)]]
    got = found(spark, docs, items)
    leaks = {d for d, i in got if i == 100}
    assert leaks == {1, 2, 3, 4, 10, 13} and leaks == {d for d, i in got if i == 101}
    assert {(d, i) for d, i in got if i >= 102} == {(12, 200)}


def test_empty(spark):
    assert found(spark, [], [(1, "a " * 30)]) == found(spark, [(1, "a " * 30)], []) == []
