"""Evaluation texts in training text: one Aho-Corasick automaton, then exact alignment.

Words are runs of letters and digits after compatibility normalisation and case folding; markup commands, braces, comment signs, line breaks,
hyphenation at line ends and punctuation do not count. A stretch of at least 15 words with at most one edit in ten words always holds a run of
6 untouched words, so the automaton holds every run of 6 words of every item and finds all candidates in one pass over a document.
From each run found, the furthest reach to either side is computed for every number of edits, which is an exact test of the rule.

The automaton is broadcast for blocks of items of at most ITEM_CHARS characters; more items mean more blocks and passes, not a larger broadcast.

Defined results: null or empty texts and items of under 15 words hold nothing; an item that occurs often in a document is reported once by
``found`` and once per run by ``spans``; equal items are reported each under its own identifier.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, RUN = 15, 6
ITEM_CHARS = 4_000_000
COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
# possessive, and only from the first letter of a run on, so that a long run is read once
HYPHEN = regex.compile(r"(?<![^\W_])([^\W_]++)[{}]*+[-\u2010\u2011\u00ad][ \t]*+\r?\n[ \t]*+%*+[ \t]*+[{}]*+([^\W_]++)")
TORN = re.compile(r"[-\u2010\u2011\u00ad][ \t]*\r?\n")
WORD = re.compile(r"[^\W_]+")
PLACED = regex.compile(r"(?P<skip>\\[a-zA-Z@]+\*?)|(?P<word>(?:[\p{L}\p{N}\p{M}]|(?<=[\p{L}\p{N}\p{M}])[{}\u00ad]+(?=[\p{L}\p{N}\p{M}]))+)")
BROKEN = re.compile(r"[{}]*[-\u2010\u2011\u00ad][ \t]*\r?\n[ \t]*%*[ \t]*[{}]*")


def folded(text: str) -> str:
    """Compatibility-normalised and case-folded, without braces and soft hyphens."""
    text = text.replace("{", "").replace("}", "")
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text.replace("\u00ad", "")).casefold()
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def words(text: str, known: set[str] = frozenset()) -> list[str]:
    """Normalised words. At a line end a hyphen joins its sides, unless only the sides by themselves are known words."""

    def join(m: regex.Match) -> str:
        a, b = folded(m[1]), folded(m[2])
        return f"{m[1]} {m[2]}" if a + b not in known and a in known and b in known else m[1] + m[2]

    if "\\" in text:
        text = COMMAND.sub(" ", text)
    if TORN.search(text):
        text = HYPHEN.sub(join, text)
    return WORD.findall(folded(text))


def placed(text: str, known: set[str]) -> list[tuple[str, int, int]]:
    """The same words with their offsets in the text."""
    out: list[tuple[str, int, int]] = []
    for m in PLACED.finditer(text):
        if m["skip"]:
            continue
        parts = WORD.findall(folded(m["word"]))
        if not parts:
            continue
        if out and BROKEN.fullmatch(text, out[-1][2], m.start()):
            a, b = out[-1][0], parts[0]
            if a + b in known or not (a in known and b in known):
                out[-1] = (a + b, out[-1][1], m.end())
                parts = parts[1:]
        out += [(w, m.start(), m.end()) for w in parts]
    return out


def reach(a: list[str], b: list[str], i: int, k: int, step: int, most: int) -> list[tuple[int, int]]:
    """For each number of edits, (words of a, words of b) consumed from a[i], b[k] in direction step, ending on an equal word, most words of a."""
    n, m = (len(a) - i, len(b) - k) if step > 0 else (i + 1, k + 1)
    front = {0: 0}  # diagonal (consumed of b - consumed of a) -> consumed of a
    out = [(0, 0)]
    for edits in range(most + 1):
        grown: dict[int, int] = {}
        best = out[-1]
        for d, x in front.items():
            y, run = x + d, 0
            while x < n and y < m and a[i + step * x] == b[k + step * y]:
                x, y, run = x + 1, y + 1, run + 1
            if run and x > best[0]:
                best = (x, y)
            for nd, nx in ((d, x + 1), (d - 1, x + 1), (d + 1, x)):  # replaced, missing, added
                if nx <= n and nx + nd <= m and nx > grown.get(nd, -1):
                    grown[nd] = nx
        if edits:
            out.append(best)
        else:
            out[0] = best
        front = grown
    return out


def aligned(item: list[str], text: list[str], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of text (first, last word) that hold the item, each from one untouched run (position in item, in text)."""
    out, seen = [], set()
    # a stretch of n words with e edits holds at least n - 6e - 5 runs and n is at least 10e, which bounds e by the number of runs
    most = min(len(item) // 10, (len(set(runs)) + 5) // 4)
    for i, k in runs:
        while i and k and item[i - 1] == text[k - 1]:
            i, k = i - 1, k - 1
        if (i, k) in seen:
            continue
        seen.add((i, k))
        right = reach(item, text, i, k, 1, most)
        left = reach(item, text, i - 1, k - 1, -1, most) if i and k else [(0, 0)] * (most + 1)
        hit = None
        for e, (x, y) in enumerate(right):
            for f, (u, v) in enumerate(left):
                size = x + u
                if size >= LEAST and 10 * (e + f) <= size and (hit is None or size > hit[0]):
                    hit = (size, k - v, k + y - 1)
        if hit:
            out.append(hit[1:])
    return out


class Automaton:
    def __init__(self, items: list[tuple[int, str]]):
        split = {i: words(t) for i, t in items if t}
        self.items = {i: w for i, w in split.items() if len(w) >= LEAST}
        self.known = {w for ws in self.items.values() for w in ws}
        at = defaultdict(list)
        for i, w in self.items.items():
            for k in range(len(w) - RUN + 1):
                at[" ".join(w[k : k + RUN])].append((i, k))
        self.scan = ahocorasick.Automaton()
        for run, places in at.items():
            self.scan.add_word(f" {run} ", places)
        if at:
            self.scan.make_automaton()
        self.any = bool(at)

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) in characters of the text."""
        flat = f" {' '.join(words(text, self.known))} "
        if next(self.scan.iter(flat), None) is None:
            return
        own = placed(text, self.known)
        line = [w for w, _, _ in own]
        flat = f" {' '.join(line)} "
        number = {}
        p = 0
        for k, w in enumerate(line):
            number[p] = k
            p += len(w) + 1
        runs = defaultdict(list)
        for end, places in self.scan.iter(flat):
            # the pattern begins on the blank before its first word
            start = end - sum(map(len, self.items[places[0][0]][places[0][1] : places[0][1] + RUN])) - RUN
            for i, k in places:
                runs[i].append((k, number[start]))
        for i, found in runs.items():
            for a, b in dict.fromkeys(aligned(self.items[i], line, found)):
                yield i, own[a][1], own[b][2]


def _scan(items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Automaton(items.value)
        for batch in batches:
            rows = []
            if own.any:
                for key, text in zip(batch.id, batch.text, strict=True):
                    if text:
                        rows += [(key, *x) for x in own.spans(text)]
            yield pd.DataFrame(rows, columns=["id", "item_id", "start_char", "end_char"])

    return run


def spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_char, end_char); documents: doc_id, text; items: item_id, text."""
    sc = documents.sparkSession.sparkContext
    slim = documents.where(F.length("text") > 0).select(F.col("doc_id").alias("id"), "text")
    parts, block, chars = [], [], 0

    def scanned() -> DataFrame:
        return slim.mapInPandas(_scan(sc.broadcast(list(block))), "id bigint, item_id bigint, start_char int, end_char int")

    for item_id, text in items.where("text is not null").select("item_id", "text").toLocalIterator():
        block.append((item_id, text))
        chars += len(text)
        if chars > ITEM_CHARS:
            parts.append(scanned())
            block, chars = [], 0
    if block or not parts:
        parts.append(scanned())
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("id", "doc_id")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return spans(documents, items).select("doc_id", "item_id").distinct()
