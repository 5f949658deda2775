import os
import random

import pytest

from colloquy.llm.encoding import Encoder, PerfectHash, default_vocabulary, encoded

needs = pytest.mark.skipif(not os.path.exists(default_vocabulary()), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder.load(default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t


def ids(encoder, texts):
    offsets, flat = encoder.encode(texts)
    flat = flat.tolist()
    return [flat[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def test_perfect_hash():
    table = {str(i).encode(): i for i in range(1000)}
    h = PerfectHash.build(table)
    assert sorted(h.keys) == sorted(table) and len(h.values) == 1000
    assert h.lookup(list(table)).tolist() == list(range(1000))
    assert h.lookup([b"x", b"", b"1001"]).tolist() == [-1, -1, -1]
    assert PerfectHash.build({b"a": 3}).lookup([b"a", b"b"]).tolist() == [3, -1]


@needs
def test_every_vocabulary_entry_is_reachable(encoder):
    assert len(encoder.whole.keys) == 50256


@needs
def test_same_as_the_public_library(encoder, reference):
    rng = random.Random(3)
    alphabet = [*"abcdefgh ABC'stdl019.,!?<|>\n\t", "  ", "é", "ß", "你", "好", "🙂", "👩🏽‍🔬", "​", " ", " ", "\x1c", "ａ", "ﬁ", "́", "ї", "'s", "'LL"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a" * 20000, " " * 3000 + "x", "\0", "don't we'VE", " ", "\n\n", "ab" * 5000 + "1" * 999]
    assert ids(encoder, texts) == [x.ids for x in reference.encode_batch(texts, add_special_tokens=False)]


@needs
def test_frames(spark, reference):
    rows = [(1, None, 3), (2, "", 3), (3, " ", 3), (4, "Hello there", 3), (4, "Hello there", 3), (None, "x", 3)]
    got = encoded(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()
    assert [list(r.ids) for r in got][:3] == [[], [], [220]]
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 4, None]
    assert got[3].ids == got[4].ids == reference.encode("Hello there", add_special_tokens=False).ids
    assert encoded(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
