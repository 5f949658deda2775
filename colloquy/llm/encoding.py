"""Byte-level BPE encoding: whole pre-tokens by a minimal perfect hash, the rest by merging linked bytes off a heap."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How this family of vocabularies cuts a text into pre-tokens; the second form is the same on ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

#: Characters that are encoded at a time, and pre-tokens remembered in a task; neither has a bearing on the result.
STRIDE, MEMO = 1 << 20, 200_000


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies: in the folder COLLOQUY_TOKENIZERS names, else /opt/tokenizers."""
    return os.path.join(os.environ.get("COLLOQUY_TOKENIZERS", "/opt/tokenizers"), name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in the vocabulary file: itself if printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class PerfectHash:
    """A minimal perfect hash of byte strings: each key has a slot of its own among exactly as many slots as keys.

    Hash and displace: a key's bucket holds a pair of displacements which moves the bucket's keys to free slots. A slot keeps
    its key, so that strings that are no key are told apart.
    """

    displacement: np.ndarray
    values: np.ndarray
    keys: list[bytes]

    @staticmethod
    def _parts(keys: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        digest = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), "uint64", len(keys))
        first = (digest >> np.uint64(32)) % np.uint64(n)
        second = (digest & np.uint64(0xFFFFFFFF)) % np.uint64(n - 1 or 1) + np.uint64(1)
        return ((digest * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(buckets), first, second

    @classmethod
    def build(cls, table: dict[bytes, int]) -> PerfectHash:
        keys = list(table)
        n, buckets = len(keys), max(1, len(keys) // 4)
        bucket, first, second = cls._parts(keys, n, buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        taken = np.zeros(n, bool)
        displacement = np.zeros(buckets, "uint64")
        slot_of = np.zeros(n, "int64")
        free: list[int] | None = None
        for b in np.argsort(-(np.diff(bounds)), kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:  # any free slot will do
                free = np.flatnonzero(~taken).tolist() if free is None else free
                d = (free.pop() - int(first[own[0]])) % n
                slots = np.array([(int(first[own[0]]) + d) % n])
                displacement[b] = d
            else:
                for low in range(0, n * n, 512):
                    d = np.arange(low, low + 512, dtype="uint64")  # d // n times the second hash, and d % n
                    s = (first[own][:, None] + (d // np.uint64(n) + np.uint64(1)) * second[own][:, None] + d % np.uint64(n)) % np.uint64(n)
                    s = s.astype("int64")
                    ok = ~taken[s].any(0)
                    if len(own) > 1:
                        ok &= (np.diff(np.sort(s, axis=0), axis=0) > 0).all(0)
                    hit = np.flatnonzero(ok)
                    if len(hit):
                        slots, displacement[b] = s[:, hit[0]], d[hit[0]] + np.uint64(n)
                        break
                else:
                    raise RuntimeError("two keys have the same digest")
            taken[slots] = True
            slot_of[own] = slots
        at = np.empty(n, "int64")
        at[slot_of] = np.arange(n)
        values = np.array(list(table.values()), "int32")
        return cls(displacement, values[at], [keys[i] for i in at.tolist()])

    def lookup(self, strings: list[bytes]) -> np.ndarray:
        """The value of each string, -1 where it is no key."""
        if not strings or not self.keys:
            return np.full(len(strings), -1, "int32")
        n = np.uint64(len(self.keys))
        bucket, first, second = self._parts(strings, len(self.keys), len(self.displacement))
        d = self.displacement[bucket.astype("int64")]
        slot = ((first + d // n * second + d % n) % n).astype("int64")
        keys = self.keys
        same = np.fromiter((keys[s] == x for s, x in zip(slot.tolist(), strings)), bool, len(strings))
        return np.where(same, self.values[slot], -1).astype("int32")


@dataclass
class Encoder:
    """A byte-level BPE vocabulary without special tokens."""

    bytes_: list[int]
    merges: dict[int, tuple[int, int]]
    whole: PerfectHash
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Encoder:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocabulary = _byte_letters(), model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = {}
        for rank, (a, b) in enumerate(pairs):
            merges.setdefault(vocabulary[a] << 20 | vocabulary[b], (rank, vocabulary[a + b]))
        by_byte = [0] * 256
        for letter, byte in letters.items():
            by_byte[byte] = vocabulary[letter]
        self = cls(by_byte, merges, PerfectHash.build({b"": 0}))
        spelled = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        #: Only tokens that merging arrives at may be looked up as a whole.
        self.whole = PerfectHash.build({s: i for s, i in spelled.items() if self.merged(s) == [i]})
        return self

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: bytes in a linked list, mergeable neighbours in a heap, the lowest rank (then the leftmost) first."""
        ids = [self.bytes_[b] for b in piece]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = ids[i] << 20 | ids[i + 1]
            if pair in merges:
                heap.append((merges[pair][0], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j] = merges[pair][1], -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                pair = ids[i] << 20 | ids[j]
                if pair in merges:
                    heapq.heappush(heap, (merges[pair][0], i, pair))
            k = before[i]
            if k >= 0:
                pair = ids[k] << 20 | ids[i]
                if pair in merges:
                    heapq.heappush(heap, (merges[pair][0], k, pair))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; a null or empty text has none."""
        pre: list[str] = []
        counts = []
        for text in texts:
            own = (_ASCII if text.isascii() else _UNICODE)(text) if text else ()
            counts.append(len(own))
            pre += own
        number: dict[str, int] = {}
        codes = np.fromiter([number.setdefault(t, len(number)) for t in pre], "int64", len(pre))
        distinct = list(number)
        found = self.whole.lookup([t.encode("utf-8", "surrogatepass") for t in distinct])
        pieces: list[tuple[int, ...]] = []
        for t, i in zip(distinct, found.tolist()):
            if i >= 0:
                pieces.append((i,))
                continue
            own = self.memo.get(t)
            if own is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                own = tuple(self.merged(t.encode("utf-8", "surrogatepass")))
                if len(t) < 64:
                    self.memo[t] = own
            pieces.append(own)
        size = np.fromiter(map(len, pieces), "int64", len(pieces))
        start = np.cumsum(size) - size
        table = np.fromiter((i for p in pieces for i in p), "int32", int(size.sum()))
        n = size[codes]
        ends = np.cumsum(n)
        ids = table[np.repeat(start[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        per_text = np.concatenate([[0], np.cumsum(counts)]).astype("int64")
        return np.concatenate([[0], ends])[per_text], ids


_ASCII = re.compile(ASCII_PATTERN, re.ASCII).findall
_UNICODE = regex.compile(PATTERN).findall


def encoded(documents: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens even where it spells one.

    Null and empty texts have an empty list, never null; white space is text. Ids and texts may repeat; each row is encoded for
    itself and nothing is shuffled. ``vocabulary`` is the path of a vocabulary file on the driver; the tables made of it, a few
    MB, go to the tasks. Other columns are ignored.
    """
    encoder = Encoder.load(vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0)))
            low = 0
            while low < len(texts):  # rows of about STRIDE characters together
                done = size[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(size, done + STRIDE, "right")))
                offsets, ids = encoder.encode(texts.slice(low, high - low).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, "int32"), pa.array(ids, "int32"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], [id_column, "ids"])
                low = high

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column), F.col(text)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
