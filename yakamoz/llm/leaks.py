"""Evaluation items that leak into a corpus, in whole or in part.

Seeds are word n-grams of the items, numbered by two look-ups (words, then pairs). A leak keeps a least number of an item's
n-grams (``least``, from the item's length and the decision below), so all of them but the ones most frequent in the corpus,
one less than that number, are seeds: whatever leaks holds a rare one. Document frequencies are counted over the whole
corpus. A document that holds a seed meets the item; the pair goes on if enough n-grams of the item lie close to one diagonal
of the alignment, and the item words that its best Smith-Waterman alignment (words; match 1, change or gap -1) spans decide.
The item table is the query side and is fixed: its index is broadcast after a check of its size. The corpus is scanned, never
shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a seed of a long item; items of PAIRS words or less are sought by pairs, of two or one by words; width of a band of
#: diagonals.
N, PAIRS, BAND = 3, 12, 8
#: Least span of the alignment, as a part of the item's words, and its least score, as a part of the span: a word in six changed.
#: A longer stretch may have more changes, as long as its score is NET of the item's words.
SPAN, SCORE, NET = 0.5, 2 / 3, 0.45
#: Postings that are looked at together.
AT_ONCE = 1 << 21
#: Items whose index may be broadcast.
MAX_ITEMS = 200_000

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))) + "]+")
_PLAIN = tuple(zip("ığüşöç", "igusoc"))


def words(text: str | None) -> list[str]:
    """Words in lower case without accents; i, ı, İ and I are one letter."""
    if not text:
        return []
    low = text.replace("İ", "i").lower()
    if not low.isascii():
        for a, b in _PLAIN:  # the usual ones; the rest is decomposed
            low = low.replace(a, b)
        if not low.isascii():
            low = _MARKS.sub("", unicodedata.normalize("NFKD", low).lower().replace("ı", "i"))
    return _WORD.findall(low)


def size_of_seed(length: int) -> int:
    return N if length > PAIRS else min(2, -(-length // 2))


def least(length: int) -> int:
    """Fewest n-grams that a leak of an item of so many words keeps, insertions aside: s words with c changed have s - n + 1 - nc or
    more, and the decision allows c up to s / 6 from half of the words on, or (s - NET * length) / 2."""
    n = size_of_seed(length)
    half = -(-length // 2)
    part = half - n + 1 - n * half * (1 - SCORE) / 2
    whole = min(s - n + 1 - n * (s - NET * length) / 2 for s in (half, length))
    return max(1, int(np.ceil(min(part, whole) - 1e-9)))


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the score: a word of ``a`` that ``b`` hasn't costs 1 within an alignment, one that it has gives 1 at most."""
    own = np.sort(b)
    has = own[np.minimum(np.searchsorted(own, a), len(own) - 1)] == a if len(own) else np.zeros(len(a), dtype=bool)
    total = np.zeros(len(a) + 1, dtype=np.int64)
    np.cumsum(2 * has - 1, out=total[1:])
    return int((total - np.minimum.accumulate(total)).max())


def score(a: np.ndarray, b: np.ndarray) -> int:
    """Smith-Waterman score of two sequences of numbers: match 1, change -1, gap -1. A row at a time; a gap along the row
    is a running maximum."""
    steps = np.arange(len(b) + 1, dtype=np.int32)
    row = np.zeros(len(b) + 1, dtype=np.int32)
    best = row.copy()
    new = np.empty_like(row)
    gain = {x: np.where(b == x, 1, -1).astype(np.int32) for x in set(a.tolist())}
    for x in a.tolist():
        new[0] = 0
        np.add(row[:-1], gain[x], out=new[1:])
        np.maximum(new[1:], row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        new += steps
        np.maximum.accumulate(new, out=row)
        row -= steps
        np.maximum(best, row, out=best)
    return int(best.max())


def span(a: list[int], b: list[int]) -> tuple[int, int]:
    """(score, words of ``a`` from the first to the last) of the best alignment; of equal ones the longest."""
    best, row = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b):
            (d, n), (u, m), (w, k) = row[j], row[j + 1], new[j]
            new.append(max((0, 0), (d + (1 if x == y else -1), n + 1), (u - 1, m + 1), (w - 1, k)))
        row = new
        best = max(best, max(row))
    return best


class Index:
    """N-grams of the items and where they stand."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.coded = [np.array([self.number.setdefault(w, len(self.number)) for w in words(t)], dtype=np.int64) for _, t in items]
        self.base = len(self.number) + 1
        self.pairs = np.unique(np.concatenate([np.empty(0, np.int64), *(c[:-1] * self.base + c[1:] for c in self.coded)]))
        lengths = [len(c) for c in self.coded]
        self.least = np.array([least(n) for n in lengths], dtype=np.int64)
        of: dict[int, list[int]] = defaultdict(list)  # items by size of their n-grams
        for k, n in enumerate(lengths):
            if n:
                of[size_of_seed(n)].append(k)
        #: size -> (sorted n-grams, start of each one's postings, their item, their place, whether they are seeds).
        self.grams: dict[int, tuple[np.ndarray, ...]] = {}
        for n, own in of.items():
            codes = [self._codes(self.coded[k], n) for k in own]
            flat = np.concatenate(codes)
            item = np.repeat(own, [len(c) for c in codes])
            place = np.concatenate([np.arange(len(c)) for c in codes])
            order = np.argsort(flat, kind="stable")
            keys, start = np.unique(flat[order], return_index=True)
            self.grams[n] = keys, np.append(start, len(flat)), item[order], place[order], np.ones(len(flat), dtype=bool)

    def _codes(self, c: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n-grams of a row of word numbers; -1 for those that no item has."""
        if n == 1 or len(c) < n:
            return c[: max(0, len(c) - n + 1)]
        pair = np.where((c[:-1] < 0) | (c[1:] < 0), -1, c[:-1] * self.base + c[1:])
        if n == 2:
            return pair
        at = self._find(self.pairs, pair)[:-1]
        return np.where((at < 0) | (c[2:] < 0), -1, at * self.base + c[2:])

    @staticmethod
    def _find(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of the codes in the sorted keys, -1 for those that aren't there."""
        if not len(keys):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return np.where(keys[at] == codes, at, -1)

    def code(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts in one row, each text followed by -1, and where each one starts."""
        get, out, start = self.number.get, [], [0]
        for t in texts:
            out += [get(w, -1) for w in words(t)]
            out.append(-1)
            start.append(len(out))
        return np.array(out, dtype=np.int64), np.array(start, dtype=np.int64)

    def held(self, coded: np.ndarray, n: int) -> np.ndarray:
        """For each n-gram of the texts its place among the items' ones, or -1."""
        return self._find(self.grams[n][0], self._codes(coded, n))

    def rank(self, frequency: dict[int, np.ndarray]) -> None:
        """Seeds by the documents that hold each n-gram: of each item all but the most frequent least - 1 places."""
        for n, (_, start, item, _, seed) in self.grams.items():
            count = np.diff(start)
            gram = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((gram, -frequency[n][gram], item))
            first = np.concatenate([[True], item[order][1:] != item[order][:-1]]) if len(order) else np.empty(0, bool)
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            dropped = nth < self.least[item[order]] - 1
            # an n-gram that an item has several times is dropped as a whole or not at all
            pair = item[order] * (len(count) + 1) + gram[order]
            kept = np.unique(pair[~dropped])
            seed[order] = ~dropped | np.isin(pair, kept)

    def met(self, coded: np.ndarray, start: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> bands of diagonals that hold enough n-grams of the item, for the pairs that share a seed."""
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        shift = 1 << 32
        for n, (_, first, item, place, seed) in self.grams.items():
            held = self.held(coded, n)
            spot = np.flatnonzero(held >= 0)
            text = np.searchsorted(start, spot, side="right") - 1
            size = (first[1:] - first[:-1])[held[spot]]
            part = np.cumsum(size) // AT_ONCE
            ends = np.flatnonzero((part[1:] != part[:-1]) & (text[1:] != text[:-1])) + 1  # whole texts, about AT_ONCE postings each
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(spot)]):
                own = size[lo:hi]
                at = np.repeat(first[held[spot[lo:hi]]] - np.cumsum(own) + own, own) + np.arange(own.sum())
                if not len(at):
                    continue
                pairs, nth, count = np.unique(np.repeat(text[lo:hi], own) * len(self.ids) + item[at], return_inverse=True, return_counts=True)
                good = np.zeros(len(pairs), dtype=bool)
                good[nth[seed[at]]] = True
                good &= count >= self.least[pairs % len(self.ids)]
                keep = good[nth]
                diagonal = np.repeat(spot[lo:hi] - start[text[lo:hi]], own)[keep] - place[at[keep]]
                keys, count = np.unique(nth[keep] * shift + diagonal // BAND + shift // 2, return_counts=True)
                pair = pairs[keys // shift]
                both = count.copy()  # a band and the next one
                both[:-1] += np.where(keys[1:] == keys[:-1] + 1, count[1:], 0)
                for x in np.flatnonzero(both >= self.least[pair % len(self.ids)]):
                    found[divmod(int(pair[x]), len(self.ids))].append(int(keys[x] % shift - shift // 2))
        return found

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(number of the text, item id, score as a part of the item's words) of the items that the texts give away."""
        all_, start = self.code(texts)
        out = []
        for (d, k), good in sorted(self.met(all_, start).items()):
            coded, size = all_[start[d] : start[d + 1] - 1], len(self.coded[k])
            top, spans, leak = 0, [], False
            for b in sorted(good):  # each band with room for words put in or left out; those that touch are one
                lo, hi = max(0, (b - 1) * BAND), (b + 3) * BAND + size
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                if bound(self.coded[k], coded[lo:hi]) < min(NET, SPAN * SCORE) * size:
                    continue
                s = score(self.coded[k], coded[lo:hi])
                top = max(top, s)
                if s >= SPAN * size:
                    leak = True
                elif not leak and s >= SPAN * SCORE * size:
                    s, wide = span(self.coded[k].tolist(), coded[lo:hi].tolist())
                    leak = wide >= SPAN * size and s >= min(SCORE * wide, NET * size)
            if leak:
                out.append((d, self.ids[k], top / size))
        return out


def frequencies(texts: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """By size, the number of documents that hold each of the items' n-grams: one number for each at most, whatever the corpus."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            coded, start = index.code(b.column(0).to_pylist())
            out = []
            for n, grams in index.grams.items():
                held = index.held(coded, n)
                spot = np.flatnonzero(held >= 0)
                own = np.unique((np.searchsorted(start, spot, side="right") - 1) * len(grams[0]) + held[spot])  # once a text
                g, k = np.unique(own % len(grams[0]), return_counts=True)
                out.append((np.full(len(g), n), g, k))
            cols = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["s", "g", "n"])

    total = {n: np.zeros(len(g[0]), dtype=np.int64) for n, g in index.grams.items()}
    for r in texts.select("text").mapInArrow(count, "s int, g bigint, n bigint").groupBy("s", "g").agg(F.sum("n").alias("n")).collect():
        total[r.s][r.g] = r.n
    return total


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``doc_id``, ``item_id``, ``score``): each document and item where half of the item's words or more stand in the document
    in a connected stretch, a few changed words apart.

    Null and empty texts and items without a word match nothing; long texts are read whole; repeated documents give repeated
    rows; empty tables give an empty result; further columns are ignored. More than MAX_ITEMS items: ValueError.
    """
    rows = items.select(F.col(item).cast("int"), item_text).where(F.col(item_text).isNotNull()).limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(column).alias("text"))
    index = Index(sorted((r[0], r[1]) for r in rows if words(r[1])))
    index.rank(frequencies(texts, index))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            got = index.leaks(b.column(1).to_pylist())
            d, i, s = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d, pa.int64())), pa.array(i, pa.int32()), pa.array(s, pa.float64())], ["doc_id", "item_id", "score"])

    return texts.mapInArrow(find, "doc_id bigint, item_id int, score double")
