"""Cutting oversized texts at natural boundaries, with overlap, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.current import current_turns

LIMIT, OVERLAP = 512, 64

#: Boundary strengths, from the weakest. A boundary inside a word is the last resort, one between paragraphs the first choice.
HARD, SPACE, SENTENCE, LINE, PARAGRAPH = range(5)
CUTS = ("hard", "space", "sentence")

#: What ends a sentence, and line breaks.
SENTENCE_END = re.compile("[.!?…]+[\"'”’»)\\]]*(?=\\s|\\Z)|[。！？]+[”’」』]*|[\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029]")
LINE_BREAK = re.compile("\r\n|[\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029]")
WORD = re.compile(r"\S+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences, without white space around them; spans without any other character are left out."""
    start = 0
    for end in [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]:
        if end > start:
            piece = text[start:end]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                yield start + left, start + len(piece.rstrip())
            start = end


def atoms(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], list[int], str]:
    """(spans of at most ``limit``, strength of the boundary before each, weakest kind of cut that was needed).

    Whole sentences; of those over the limit the words; of words over it slices that leave room for the overlap.
    """
    slice_ = max(1, limit - overlap)
    spans: list[tuple[int, int]] = []
    strength: list[int] = []
    worst = SENTENCE
    before = 0
    for start, end in sentences(text):
        breaks = len(LINE_BREAK.findall(text, before, start))
        first = PARAGRAPH if breaks > 1 else LINE if breaks else SENTENCE
        before = end
        if end - start <= limit:
            spans.append((start, end))
            strength.append(first)
            continue
        worst = min(worst, SPACE)
        for word in WORD.finditer(text, start, end):
            a, b = word.span()
            if b - a > limit:
                worst = HARD
            for at in range(a, b, slice_ if b - a > limit else limit):
                spans.append((at, min(at + (slice_ if b - a > limit else limit), b)))
                strength.append(first if at == start else SPACE if at == a else HARD)
    return spans, strength, CUTS[worst]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], str]:
    """([(start, end, shared)], cut): spans of at most ``limit`` that cover all but white space between them.

    ``shared`` is how many leading characters a piece repeats of the one before, at most ``overlap``, and fewer where the limit or
    the length of what comes before asks for it; it begins at a word where one begins in reach. Adjacent atoms wait in a heap;
    the weakest boundary goes first, of equals the one whose merger is the smallest, then the leftmost, as long as both sides
    and the overlap fit together.
    """
    spans, strength, cut = atoms(text, limit, overlap)
    n = len(spans)
    start, end = [a for a, _ in spans], [b for _, b in spans]
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    fits = lambda i, j: end[j] - start[i] + (overlap if i else 0) <= limit
    heap = [(strength[j], end[j] - start[j - 1], j - 1, j) for j in range(1, n) if fits(j - 1, j)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[j] < n:
            before[after[j]] = i
            if fits(i, after[j]):
                heapq.heappush(heap, (strength[after[j]], end[after[j]] - start[i], i, after[j]))
        if before[i] >= 0 and fits(before[i], i):
            heapq.heappush(heap, (strength[i], end[i] - start[before[i]], before[i], i))
    out, previous = [], 0
    for i in (i for i in range(n) if alive[i]):
        a = start[i]
        if out:
            a = _overlap_start(text, max(previous, start[i] - overlap, end[i] - limit), start[i])
        out.append((a, end[i], start[i] - a))
        previous = start[i]
    return out, cut


def _overlap_start(text: str, low: int, start: int) -> int:
    """Where the overlap before ``start`` begins: at the first word that begins in reach, else as far back as allowed."""
    if low <= 0 or text[low - 1].isspace():
        at = low
    else:
        space = re.compile(r"\s").search(text, low, start)
        at = space.end() if space else low
    while at < start and text[at].isspace():
        at += 1
    return at


PIECE = "array<struct<piece:int,p_start:int,p_end:int,shared:int,text:string>>"


def split_texts(items: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``items`` whose text is longer than ``limit`` characters, with ``cut`` and ``pieces``.

    pieces: numbered from 0, each with its span in code points, the characters shared with the piece before, and its text. cut is
    the weakest boundary that atoms of at most ``limit`` need: sentence, space or hard. Items at or under the limit, empty and null
    texts are not returned: the filter is a Catalyst one, so no shorter text reaches Python. Items are independent, there is no
    shuffle; a text of n atoms takes n log n steps. A text of white space alone has no pieces and cut ``sentence``. Columns of the
    names cut and pieces are replaced; all others stay.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans, cut = pieces(t, limit, overlap)
            rows.append((cut, [(k, a, b, s, t[a:b]) for k, (a, b, s) in enumerate(spans)]))
        return pd.DataFrame(rows, columns=["cut", "pieces"])

    split = F.pandas_udf(run, f"cut string, pieces {PIECE}")
    long = items.where(F.char_length(text) > limit).withColumn("__split", split(F.col(text)))
    return long.withColumns({"cut": F.col("__split.cut"), "pieces": F.col("__split.pieces")}).drop("__split")


def split_turns(conversations: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(conversation_id, turn_id, cut, pieces): every turn of current conversations whose text exceeds ``limit`` characters.

    Distinct turns under one turn_id are rows of their own. Only long texts are moved in the one shuffle.
    """
    long = current_turns(
        conversations,
        where=lambda t: F.char_length(t["text"]) > limit,
        turn_id=lambda t: t["turn_id"],
        text=lambda t: t["text"],
        __content=lambda t: F.xxhash64(t["speaker"], t["start"], t["end"]),
    )
    return split_texts(long, "text", limit, overlap).select("conversation_id", "turn_id", "cut", "pieces")
