"""Evaluation items that occur, wholly or partly, in the documents of a corpus."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.splitting import sentences
from colloquy.llm.words import words

#: Most item rows, and characters of them, that are indexed on the driver and sent to the tasks.
MOST_ITEMS, MOST_CHARACTERS = 100_000, 50_000_000

PIECE = 3  # words that a piece begins with and that must be hit exactly
CHUNK = 16  # most words of a chunk; a chunk of m words may have m // PIECE - 1 errors
LEAST_WORDS = 20
SHARE = 0.45  # of an item, by words found unchanged: half of it, with a tenth of that changed
EDGE = 4  # words at the ends of a passage that may lie in chunks of which no piece is whole
BEGINNING = 8  # words that items with a shared instruction have in common at least


@dataclass
class Item:
    """One distinct item text: its ids, how many words it has, how many of them, at its beginning, are a shared instruction."""

    ids: list[int]
    size: int
    shared: int


def chunk_spans(text: str) -> list[tuple[int, int]]:
    """Spans over the words of ``text``: its sentences; those of fewer than 6 words join the next, or the last one, those over CHUNK are cut evenly."""
    sizes = [len(words(text[a:b])) for a, b in sentences(text)]
    ends, start, end = [0], 0, 0
    for size in sizes:
        end += size
        if end - start >= 6:
            ends.append(end)
            start = end
    if end > ends[-1]:
        ends[-1 if len(ends) > 1 else len(ends) :] = [end]
    spans = []
    for a, b in zip(ends, ends[1:]):
        cuts = np.linspace(a, b, -(-(b - a) // CHUNK) + 1).astype(int).tolist()
        spans += list(zip(cuts, cuts[1:]))
    return spans


def shared_beginnings(texts: list[tuple[int, ...]]) -> list[int]:
    """How many words of each text are the beginning that at least half, and at least two, of the others with the same first words share.

    The texts go down together, a word at a time, and one is left behind where too few go its way: linear in the words that are shared.
    """
    groups: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t[:BEGINNING]].append(i)
    out = [0] * len(texts)
    for members in groups.values():
        need = max(2, -(-(len(members) - 1) // 2)) + 1
        alive, way, depth = np.array(members), np.zeros(len(members), "int64"), BEGINNING
        while len(alive) >= need:
            for i in alive.tolist():
                out[i] = depth
            longer = np.array([len(texts[i]) > depth for i in alive.tolist()])
            alive, way = alive[longer], way[longer]
            step = np.array([texts[i][depth] for i in alive.tolist()], "int64")
            _, where, counts = np.unique(np.stack([way, step]), axis=1, return_inverse=True, return_counts=True)
            where = where.ravel()
            alive, way, depth = alive[counts[where] >= need], where[counts[where] >= need], depth + 1
    return out


def piece_starts(size: int) -> list[int]:
    """Where the pieces of a chunk begin: one more than the errors it may have, each of at least PIECE words."""
    n = max(1, size // PIECE)
    return [i * size // n for i in range(n)]


class Index:
    """Pieces and chunks of all items.

    An item is cut into chunks of up to CHUNK words. A chunk of m words counts as found with an edit distance, by words, of at most
    k = m // PIECE - 1, and is split into k + 1 pieces: of k errors each spoils one piece at most, so one of them is hit exactly,
    and every place where the chunk can be lies k words at most from where that piece puts it. What is verified and what is
    looked up have the same budget; nothing is lost between them.
    """

    def __init__(self, rows: list[tuple[int, str]], share: float = SHARE):
        texts: dict[tuple[int, ...], tuple[list[int], str]] = {}
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        for item_id, text in sorted(rows):
            w = words(text or "")
            if len(w) >= LEAST_WORDS:
                ids, _ = texts.setdefault(tuple(map(number, w)), ([], text))
                if item_id not in ids[-1:]:
                    ids.append(item_id)
        shared = shared_beginnings(list(texts))
        self.share = share
        self.items = [Item(ids, len(w), n if len(w) - n >= LEAST_WORDS // 2 else 0) for (w, (ids, _)), n in zip(texts.items(), shared)]
        begin, size, item_of, place, at = [], [], [], [], 0
        pieces: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, ((w, (_, text)), item) in enumerate(zip(texts.items(), self.items)):
            spans = chunk_spans(text)
            if not spans or spans[-1][1] != len(w):  # words that only exist across sentences
                cuts = np.linspace(0, len(w), -(-len(w) // CHUNK) + 1).astype(int).tolist()
                spans = list(zip(cuts, cuts[1:]))
            for a, b in spans:
                for o in piece_starts(b - a):
                    if a + o + PIECE <= b and a + o + PIECE > item.shared:  # a piece within the instruction tells nothing
                        pieces[0].append(at + a + o)
                        pieces[1].append(len(begin))
                        pieces[2].append(o)
                begin.append(at + a)
                size.append(b - a)
                place.append(a)
                item_of.append(i)
            at += len(w)
        self.words = np.fromiter((x for w in texts for x in w), "int32", at)
        self.begin, self.size, self.item_of, self.place = (np.array(x, "int32") for x in (begin, size, item_of, place))
        self.budget = np.maximum(0, self.size // PIECE - 1)
        item_size, item_shared = np.array([x.size for x in self.items] or [1]), np.array([x.shared for x in self.items] or [0])
        self.own = np.minimum(self.size, np.maximum(0, self.place + self.size - item_shared[self.item_of])) if at else self.size
        self.lengths = item_size
        #: Words that must be covered in all, and of those that are not part of an instruction.
        self.need, self.need_own = share * item_size, 0.8 * share * (item_size - item_shared)
        first = np.array(pieces[0], "int64")
        keys = self.key(self.words[first], self.words[first + 1], self.words[first + 2]) if len(first) else np.zeros(0, "uint64")
        order = np.argsort(keys, kind="stable")
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.offsets = np.append(starts, len(keys)).astype("int64")
        self.chunk, self.inside = np.array(pieces[1], "int32")[order], np.array(pieces[2], "int16")[order]
        bits = max(16, min(26, int(len(keys)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype("int64")] = True

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """64 bits of three words, well mixed at the top."""
        h = a.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29)) ^ b.astype("uint64")) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32)) ^ c.astype("uint64")) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31)) ^ (h << np.uint64(33))

    def hits(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, chunk, where among all words the chunk would begin) of all exact piece hits."""
        none = np.zeros(0, "int64")
        if len(numbers) < PIECE or not len(self.keys):
            return none, none, none
        a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & (doc[:-2] == doc[2:]))
        keys = self.key(a[at], b[at], c[at])
        ok = self.seen[(keys >> self.shift).astype("int64")]
        at, keys = at[ok], keys[ok]
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        ok = self.keys[found] == keys
        at, found = at[ok], found[ok]
        if not len(at):
            return none, none, none
        n = self.offsets[found + 1] - self.offsets[found]
        posting = np.repeat(self.offsets[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        where = np.repeat(at, n)
        return doc[where], self.chunk[posting].astype("int64"), where - self.inside[posting]

    def distances(self, numbers: np.ndarray, chunk: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Myers' bit-parallel edit distance of each chunk to the best place within ``numbers[low:high]``: (distance, its last word).

        All rows advance together, a word of their text at a time; a chunk is one machine word.
        """
        one, n = np.uint32(1), len(chunk)
        size = self.size[chunk].astype("int32")
        top = (size - 1).astype("uint32")
        columns = np.arange(CHUNK)
        pattern = self.words[np.minimum(self.begin[chunk][:, None] + columns, len(self.words) - 1)]
        pattern[columns >= size[:, None]] = -2
        vp, vn = np.full(n, ~np.uint32(0)), np.zeros(n, "uint32")
        score, best, end = size.copy(), size.copy(), low.copy()
        numbers = numbers.astype("int32")
        for j in range(int((high - low).max(initial=0))):
            at = low + j
            text = np.where(at < high, numbers[np.minimum(at, len(numbers) - 1)], -1)
            eq = np.packbits(pattern == text[:, None], axis=1, bitorder="little").view("<u2")[:, 0].astype("uint32")
            xv = eq | vn
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(xh | vp), vp & xh
            score += ((hp >> top) & one).view("int32")
            score -= ((hn >> top) & one).view("int32")
            hp <<= one
            hn <<= one
            vp, vn = hn | ~(xv | hp), hp & xv
            better = (score < best) & (at < high)
            best[better], end[better] = score[better], at[better]
        return best, end

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(position of the text, item, words covered) for every leak in a batch of texts."""
        get, zero = self.vocabulary.get, 0
        numbers = [[get(w, zero) for w in words(t)] if t else [] for t in texts]
        length = np.array([len(x) for x in numbers], "int64")
        flat = np.fromiter((w for x in numbers for w in x), "int64", int(length.sum()))
        doc = np.repeat(np.arange(len(texts)), length)
        bounds = np.concatenate([[0], np.cumsum(length)])
        text_of, chunk, start = self.hits(flat, doc)
        if not len(chunk):
            return
        # a leak's chunks lie within a stretch of three times the item's length: in some stretch the chunks hit must suffice
        item = self.item_of[chunk].astype("int64")
        pair = text_of * len(self.items) + item
        order = np.argsort(pair, kind="stable")
        edges = np.flatnonzero(np.diff(pair[order], prepend=-1, append=-1))
        many = np.zeros(len(pair), bool)
        many[order] = np.repeat(np.diff(edges) * CHUNK, np.diff(edges)) >= self.need_own[item[order]] - EDGE
        pair, item, start, chunk = pair[many], item[many], start[many], chunk[many]
        if not len(pair):
            return
        enough = np.zeros(len(pair), bool)
        for shift in (0, 1):
            reach = 4 * self.lengths[item]
            cell = (start + reach * shift // 2 + (1 << 40)) // reach
            order = np.lexsort((chunk, cell, pair))
            p, c, h = pair[order], cell[order], chunk[order]
            fresh = np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1]))
            covered = np.add.reduceat(np.where(np.append(True, fresh[1:] | (h[1:] != h[:-1])), self.own[h], 0), np.flatnonzero(fresh))
            ok = np.repeat(covered, np.diff(np.append(np.flatnonzero(fresh), len(p)))) >= self.need_own[item[order]] - EDGE
            enough[order[ok]] = True
        pair, start, chunk = pair[enough], start[enough], chunk[enough]
        order = np.lexsort((start, chunk, pair))
        pair, start, chunk = pair[order], start[order], chunk[order]
        fresh = np.append(True, (pair[1:] != pair[:-1]) | (chunk[1:] != chunk[:-1]) | (start[1:] != start[:-1]))[: len(pair)]
        pair, start, chunk = pair[fresh], start[fresh], chunk[fresh]
        slack = self.budget[chunk]
        text_of = pair // len(self.items)
        low = np.maximum(start - slack, bounds[text_of])
        high = np.minimum(start + self.size[chunk] + slack, bounds[text_of + 1])
        distance, end = np.zeros(len(chunk), "int64"), np.zeros(len(chunk), "int64")
        for i in range(0, len(chunk), 1 << 15):
            part = slice(i, i + (1 << 15))
            distance[part], end[part] = self.distances(flat, chunk[part], low[part], high[part])
        ok = distance <= slack
        pair, chunk, distance, end = pair[ok], chunk[ok], distance[ok], end[ok]
        edges = np.flatnonzero(np.diff(pair, prepend=-1, append=-1))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d, k = divmod(int(pair[i]), len(self.items))
            total, own = self._covered(k, chunk[i:j], end[i:j], distance[i:j], flat, int(bounds[d]), int(bounds[d + 1]))
            if total >= self.need[k] and own >= self.need_own[k]:
                yield d, k, total

    def _covered(self, item: int, chunk: np.ndarray, end: np.ndarray, distance: np.ndarray, flat: np.ndarray, begin: int, stop: int) -> tuple[int, int]:
        """Words of an item, in all and beside an instruction, in the best chain of chunks found in order and near to each other.

        Near: no two neighbours are further apart than twice the item's length. A chain that falls short by no more than two chunks
        is prolonged at both ends by the part of the next chunk that is there: a passage may be cut inside a sentence.
        """
        order = np.lexsort((chunk, end))
        chunk, end, distance = chunk[order], end[order], distance[order]
        reach, n = 2 * int(self.lengths[item]), len(chunk)
        kept = self.size[chunk] - distance
        mine = np.minimum(self.own[chunk], kept)
        total, own, before = kept.astype("int64"), mine.astype("int64"), np.full(n, -1)
        for x in range(1, n):
            y = np.flatnonzero((chunk[:x] < chunk[x]) & (end[:x] < end[x]) & (end[x] - end[:x] <= reach))
            if len(y):
                b = y[np.argmax(total[y])]
                total[x], own[x], before[x] = total[b] + kept[x], own[b] + mine[x], b
        best = int(np.argmax(total))
        have, have_own = int(total[best]), int(own[best])
        short = max(self.need[item] - have, self.need_own[item] - have_own)
        if not 0 < short <= 2 * CHUNK:
            return have, have_own
        head = best
        while before[head] >= 0:
            head = before[head]
        first, last = int(chunk[head]), int(chunk[best])
        earlier = first - 1 if first > 0 and self.item_of[first - 1] == item else -1
        later = last + 1 if last + 1 < len(self.size) and self.item_of[last + 1] == item else -1
        if sum(int(self.size[c]) for c in (earlier, later) if c >= 0) < short:
            return have, have_own
        if earlier >= 0:
            left = int(end[head]) - int(self.size[first]) + 1
            near = flat[max(begin, left - 2 * CHUNK) : left + int(self.budget[first])][::-1]
            more = _prefix(self.words[self.begin[earlier] : self.begin[earlier] + self.size[earlier]][::-1], near, int(self.budget[first]) * 2)
            have, have_own = have + more, have_own + min(more, int(self.own[earlier]))
        if later >= 0:
            near = flat[int(end[best]) + 1 : min(stop, int(end[best]) + 1 + 2 * CHUNK)]
            more = _prefix(self.words[self.begin[later] : self.begin[later] + self.size[later]], near, int(self.budget[later]))
            have, have_own = have + more, have_own + min(more, int(self.own[later]))
        return have, have_own


def _prefix(pattern: np.ndarray, text: np.ndarray, late: int) -> int:
    """How many words of a beginning of ``pattern`` are at a beginning of ``text``, of which up to ``late`` words may be skipped, with an error in three words at most."""
    row = [0 if i <= late else i - late for i in range(len(text) + 1)]
    best = 0
    if not np.isin(pattern[: 2 * PIECE], text[: late + 4 * PIECE]).any():
        return 0
    for k, w in enumerate(pattern.tolist(), 1):
        new = [k]
        for i, t in enumerate(text.tolist(), 1):
            new.append(min(row[i - 1] + (w != t), row[i] + 1, new[i - 1] + 1))
        row = new
        errors = min(row)
        if errors * PIECE <= k:
            best = max(best, k - errors)
    return best


def read_items(eval_items: DataFrame) -> list[tuple[int, str]]:
    """The items' distinct (item_id, text), bounded by MOST_ITEMS and MOST_CHARACTERS."""
    rows = eval_items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    if n > MOST_ITEMS or size > MOST_CHARACTERS:
        raise ValueError(f"{n} items of {size} characters: more than are held in memory; run them in parts")
    return [(r.item_id, r.text) for r in rows.collect()]


def leaked_items(documents: DataFrame, eval_items: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered): the documents that repeat half of an item's words or more, in order and in one place.

    One pass over the documents, no shuffle: the items are a bounded index that goes to every task. Documents whose exact piece
    hits allow for a leak are verified by edit distance, sentence by sentence, and the sentences found must follow each other. Two ids of one
    text give two rows. Items under 20 words, null and blank ones have no rows, nor do empty and null documents. Texts of any
    length are processed whole. Other columns, whatever their names, are ignored; repeated rows give repeated results.
    """
    index = Index(read_items(eval_items))
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch.iloc[:, 0].to_numpy(object), batch.iloc[:, 1].tolist()
            out = [(ids[d], i, n) for d, item, n in index.matches(texts) for i in index.items[item].ids]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered"])

    rows = documents.select(F.col(id_column), F.col(text)).where(F.char_length(text) > 0)
    return rows.mapInPandas(run, f"doc_id {kind}, item_id bigint, covered bigint")
