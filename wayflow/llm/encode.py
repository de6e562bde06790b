"""Encoding of a corpus by a public byte-level BPE vocabulary: speculate, verify, merge only what fails.

Texts are split into words by the vocabulary's pattern. For every word not seen before, greedy longest match proposes tokens. A sequence of tokens
is what the merges produce exactly if every adjacent pair is, that is, if merging the pair's bytes gives the two tokens back; the pairs of
all new words are tested at once against a growing table of tested pairs. Words with a failing pair are merged exactly, on a heap.

Defined results: an empty or null text gives an empty list; strings that look like special tokens are ordinary text. The vocabulary, under a
megabyte, is read by the driver from a path that is a parameter, and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges (a fixed value of the vocabulary). Blanks are Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and pairs remembered by a task, and characters encoded at once.
WORDS, PAIRS, CHARS = 400_000, 2_000_000, 4_000_000


class Encoder:
    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.longest: dict[bytes, int] = {}
        for b in self.ranks:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def guess(self, word: bytes) -> list[int]:
        if (one := self.ranks.get(word)) is not None:
            return [one]
        out, i, n = [], 0, len(word)
        while i < n:
            for size in range(min(self.longest.get(word[i : i + 2], 1), n - i), 0, -1):
                if (token := self.ranks.get(word[i : i + size])) is not None:
                    break
            out.append(token)
            i += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves: always the leftmost pair of lowest rank."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        alive = [True] * n
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            k = end[i] if alive[i] else n
            if k >= n or end[k] != stop:
                continue
            alive[k] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        guesses = [self.guess(b) for b in raw]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        keys = flat[:-1] << 20 | flat[1:]
        inner = np.ones(len(keys), bool)
        inner[np.cumsum(sizes)[:-1] - 1] = False  # from one word to the next is no pair
        distinct, where = np.unique(keys[inner], return_inverse=True)
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        good = np.empty(len(distinct), bool)
        for k, key in enumerate(distinct.tolist()):
            if (ok := self.pairs.get(key)) is None:
                a, b = key >> 20, key & 0xFFFFF
                ok = self.pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            good[k] = ok
        bad = np.zeros(len(keys) + 1, bool)
        bad[:-1][inner] = ~good[where]
        starts = np.cumsum(sizes) - sizes
        failing = np.add.reduceat(bad, starts) > 0 if len(starts) else bad
        for w, b, ids, fails in zip(new, raw, guesses, failing.tolist(), strict=True):
            self.words[w] = self.merge(b) if fails else ids

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        if len(self.words) > WORDS:
            self.words.clear()
        split = [self.split(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.words)
        if new:
            self.learn(list(new))
        return split


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < CHARS):
                    chars += len(texts[hi] or "")
                    hi += 1
                split = own.encode([t or "" for t in texts[lo:hi]])
                known = own.words.__getitem__
                ids = [list(chain.from_iterable(map(known, words))) for words in split]
                sizes = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), out=sizes[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["id", "ids"])
                lo = hi

    return run


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    raw = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    slim = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_encode(raw), f"id {kind}, ids array<int>").withColumnRenamed("id", key)
