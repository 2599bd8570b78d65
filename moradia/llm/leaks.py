"""Evaluation texts inside training texts (problem 8).

Spaced seeds: masks over word positions ignore the positions marked 0, so a seed still hits where single words were
replaced. The masks are all those in which no two ignored positions touch, so every run with enough equal words and only
single words replaced holds a seed, down to every second word. Hashes of all seeds of the held-out texts are sorted, broadcast in
blocks of proven size and joined with the seeds of every document; around the hits the overlap is verified exactly.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run holds at least so many equal words (or all that must be found, where that is less), and no more than so many unequal ones between two of them.
LEAST, GAP = 4, 1
#: Held-out texts of one broadcast block.
BLOCK = 20_000
SHARE = 0.5

_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]|[^\W_぀-ヿ㐀-鿿가-힯฀-๿]+")


def words(text: str) -> list[str]:
    """Words without case, accents and punctuation; in scripts without spaces each character counts as a word."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


def seeds(x: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask at every position; 0 where one of them is unknown (negative) or beyond the end."""
    at = [k for k, c in enumerate(mask) if c == "1"]
    n = len(x) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.full(n, 1469598103934665603, np.uint64), np.ones(n, bool)
    for k in at:
        w = x[k : k + n]
        known &= w >= 0
        h = (h ^ w.astype(np.uint64)) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def masks(weight: int) -> list[str]:
    """All masks of ``weight`` compared positions in which ignored positions stand alone: 2 to the power of ``weight - 1``."""
    return ["1" + "".join(gap) for gap in product(("1", "01"), repeat=weight - 1)]


class Items:
    """The held-out texts of one block with their seeds."""

    def __init__(self, rows: list[tuple[int, str]], share: float = SHARE) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in rows]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], np.int64) for _, t in rows]
        self.least = [max(1, min(LEAST, math.ceil(share * len(x) - 1e-9))) for x in self.words]
        own: dict[str, list[tuple[np.ndarray, int]]] = {}
        for k, x in enumerate(self.words):
            for mask in masks(self.least[k]):
                own.setdefault(mask, []).append((seeds(x, mask), k))
        self.tables = []
        for mask, parts in own.items():
            flat = np.concatenate([h for h, _ in parts])
            item, at = np.concatenate([np.full(len(h), k) for h, k in parts]), np.concatenate([np.arange(len(h)) for h, _ in parts])
            order = np.argsort(flat, kind="stable")
            self.tables.append((mask, flat[order], item[order], at[order]))

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in ``x``, text and position in it of every seed in common: a join of sorted hashes."""
        found = []
        for mask, keys, item, at in self.tables:
            h = seeds(x, mask)
            here = np.nonzero(h)[0]
            lo, hi = np.searchsorted(keys, h[here], "left"), np.searchsorted(keys, h[here], "right")
            n = hi - lo
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(here, n), item[rows], at[rows]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def runs(item: np.ndarray, doc: np.ndarray, shift: int, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """Runs of equal words under one shift: ``(first and last position in the item, first position in the text, equal words)``."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.nonzero(item[a:b] == doc[a + shift : b + shift])[0] + a
    if not len(same):
        return []
    cuts = np.nonzero(np.diff(same) > GAP + 1)[0] + 1
    return [(int(s[0]), int(s[-1]), int(s[0]) + shift, len(s)) for s in np.split(same, cuts) if len(s) >= least]


def covered(item: np.ndarray, doc: np.ndarray, shifts: set[int], least: int = LEAST) -> int:
    """Words of the item that one run, or two in the item's order, cover in the text; replaced single words inside a run count."""
    found = sorted({r for s in shifts for r in runs(item, doc, s, least)})
    best = max((b - a + 1 for a, b, _, _ in found), default=0)
    for k, (a1, b1, p1, _) in enumerate(found):
        for a2, b2, p2, _ in found[k + 1 :]:
            cut = max(a2, b1 + 1)  # where both would claim a word, the first has it
            if cut <= b2 and p2 + (cut - a2) > p1 + (b1 - a1):
                best = max(best, b1 - a1 + 1 + b2 - cut + 1)
    return best


def block_leaks(documents: DataFrame, rows: list[tuple[int, str]], share: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(rows)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, share)
        known = items.vocabulary
        for b in batches:
            out: list[tuple[int, int, float]] = []
            docs = [np.array([known.get(w, -1) for w in words(t)], np.int64) if t else np.zeros(0, np.int64) for t in b.column(1).to_pylist()]
            starts = np.cumsum([0] + [len(d) + 1 for d in docs])
            gap = np.array([-1], np.int64)
            x = np.concatenate([p for d in docs for p in (d, gap)]) if docs else gap
            p, item, q = items.hits(x)
            doc = np.searchsorted(starts, p, "right") - 1
            shifts: dict[tuple[int, int], set[int]] = defaultdict(set)
            for d, k, shift in np.unique(np.stack([doc, item, p - starts[doc] - q], 1), axis=0).tolist():
                shifts[d, k].add(shift)
            ids = b.column(0).to_pylist()
            for (d, k), s in shifts.items():
                n = len(items.words[k])
                c = covered(items.words[k], docs[d], s, items.least[k])
                if c >= share * n:
                    out.append((ids[d], items.ids[k], c / n))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "parte"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(look, "doc_id bigint, item_id bigint, parte double")


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, parte`` of each document in which at least ``share`` of the words of an item stand in one run or two.

    The items come to the driver block by block and each block is looked for in a pass of its own, so nothing larger
    than a block is held or broadcast. Items of few words are found by masks of fewer positions. Null or wordless texts on
    either side give no row; repeated documents or items give a row each time.
    """
    rows = ((r[0], r[1]) for r in items.select("item_id", "texto").filter(F.col("texto").isNotNull()).toLocalIterator() if words(r[1]))
    parts = []
    while (taken := list(islice(rows, block))) or not parts:
        parts.append(block_leaks(documents, taken, share))
        if len(taken) < block:
            break
    return reduce(DataFrame.unionByName, parts)
