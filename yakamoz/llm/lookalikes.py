"""Text that looks the same in one consistent form.

Look-alikes are pairs of strings or code points: fixed tables for letters of other scripts, Unicode rules for full-width
forms, blanks, invisible characters, ligatures and styled letters. Union-find makes them transitive classes. The corpus
decides which member of a class stays: the most frequent one, counted over all texts of the table. Texts are rewritten by
leftmost-longest matches of an Aho-Corasick automaton over all other members, and composed (NFC) around it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.runtime import cut

# Letters that look like the Latin letter below them.
CYRILLIC = "АВЕЅІЈКМНОРСТХԌԚԜҮһаеорсухіѕјԁԛԝүѵӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXGQWYhaeopcyxisjdqwyvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανυϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXoavucj"
OTHER = "ɑɡꞌ‐‑"
OTHER_LATIN = "ag'--"
# Strings of several code points that look like the letter.
STRINGS = (("i̇", "i"), ("ı̇", "i"), ("j̇", "j"), ("ȷ̇", "j"), ("Ӏ", "I"))
#: Format characters that are seen.
_SEEN_FORMATS = re.compile("[؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd]")


class UnionFind:
    """Classes of hashable items."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x: str) -> str:
        root = x
        while (p := self.parent.setdefault(root, root)) != root:
            root = p
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values() if len(c) > 1]


def relation() -> Iterator[tuple[str, str]]:
    """Pairs that look the same; '' stands for nothing."""
    yield from zip(CYRILLIC, CYRILLIC_LATIN)
    yield from zip(GREEK, GREEK_LATIN)
    yield from zip(OTHER, OTHER_LATIN)
    yield from STRINGS
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs", "Lo", "So"):
            continue
        if kind == "Zs":
            yield ch, " "
        elif (kind == "Cf" and not _SEEN_FORMATS.match(ch)) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp == 0x34F:
            yield ch, ""
        elif 0xFF01 <= cp <= 0xFF5E or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F or 0x1D400 <= cp <= 0x1D7FF:
            yield ch, unicodedata.normalize("NFKC", ch)
    for cp in (0x115F, 0x1160, 0x3164, 0xFFA0):
        yield chr(cp), ""


@lru_cache(1)
def classes() -> tuple[tuple[str, ...], ...]:
    """The transitive look-alike classes."""
    uf = UnionFind()
    for a, b in relation():
        uf.union(a, b)
    return tuple(map(tuple, uf.classes()))


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """member -> the most frequent member of its class; nothing stands for all that is invisible, ties go to an
    ASCII member, then to the shortest and the first in code order."""
    out = {}
    for members in classes():
        best = "" if "" in members else max(members, key=lambda m: (counts.get(m, 0), m.isascii(), -len(m), [-ord(c) for c in m]))
        out |= {m: best for m in members if m != best}
    return out


class Rewriter:
    """Rewrites texts to the consistent form."""

    def __init__(self, to: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for m, best in to.items():
            if m:
                self.automaton.add_word(m, (len(m), best))
        self.automaton.make_automaton()
        self.ends = frozenset(m[-1] for m in to if m)

    def _pass(self, text: str) -> str:
        if self.ends.isdisjoint(text):
            return text
        out, at = [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            out += text[at : end - n + 1], best
            at = end + 1
        return "".join((*out, text[at:]))

    def __call__(self, text: str) -> str:
        new = self._pass(unicodedata.normalize("NFC", text))
        if new == text:
            return text
        # a rewritten letter may compose with the accent after it, and so on to the fixed point; should forms ever take turns, the
        # first of them in code order is theirs
        seen = [text]
        while new not in seen:
            seen.append(new)
            new = self._pass(unicodedata.normalize("NFC", new))
        return min(seen[seen.index(new) :])


@lru_cache(4)
def _rewriter(to: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(dict(to))


def rewriter(to: dict[str, str]) -> Rewriter:
    """One automaton for each Python worker."""
    return _rewriter(tuple(sorted(to.items())))


@lru_cache(1)
def plain_rewriter() -> Rewriter:
    """One for each worker whose representatives don't depend on a corpus: ASCII where there is a choice."""
    return Rewriter(representatives({}))


def count_members(texts: DataFrame) -> dict[str, int]:
    """Occurrences of every class member in the only column of ``texts``, over all rows. Tasks count code points batch by
    batch; what reaches the driver is one number for each of the (fixed, some thousand) members at most."""
    singles = np.array(sorted({ord(m) for c in classes() for m in c if len(m) == 1}), dtype=np.int64)
    strings = [m for c in classes() for m in c if len(m) > 1]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            text = "\n".join(x for x in b.column(0).to_pylist() if x)
            seen, n = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"), return_counts=True)
            hit = np.isin(seen, singles)
            total.update(dict(zip(map(chr, seen[hit].tolist()), n[hit].tolist())))
            for s in strings:
                if s[-1] in text and (k := text.count(s)):
                    total[s] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["m", "n"])

    return {r.m: r.n for r in texts.mapInArrow(count, "m string, n bigint").groupBy("m").agg(F.sum("n").alias("n")).collect()}


def consistent_form(df: DataFrame, column: str, keep: list[str], to: dict[str, str]) -> DataFrame:
    """``keep`` columns and ``form``, the consistent form of ``column``; null stays null."""
    x = df.select(*keep, F.col(column).alias("__text"))

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rewriter(to)
        for b in batches:
            form = pa.array([None if t is None else f(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], form], [*b.schema.names[:-1], "form"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "__text"]
    return x.mapInArrow(rewrite, ", ".join([*fields, "form string"]))


def look_alike_pairs(df: DataFrame, key: str, column: str, scope: str | None = None, tbl: str = "") -> DataFrame:
    """(``tbl``, ``key_a``, ``key_b``), key_a < key_b: each pair of rows (of the same ``scope``) whose values differ and have one
    consistent form.

    Only digests are moved. A form can hold different values only if one of its rows was changed by rewriting, so rows of
    other forms leave before the pairs are made, and pairs grow from different values, never from equal rows. Null and blank values, repeated
    equal values and empty tables give no pairs; a null scope is a scope of its own; other columns are ignored.
    """
    x = df.select(
        F.col(key).cast("bigint").alias("id"),
        (F.coalesce(F.col(scope).cast("string"), F.lit("\0")) if scope else F.lit("")).alias("scope"), F.col(column).alias("value"),
    )
    form = consistent_form(x, "value", ["id", "scope", "value"], representatives(count_members(x.select("value"))))
    keyed = cut(form.where(F.length(F.regexp_replace("form", r"(?U)\s+", "")) > 0).select(
        "id", F.unhex(F.md5(F.concat_ws("\1", "scope", "form"))).alias("k"), F.unhex(F.md5("value")).alias("v"),
        F.md5("form").alias("_f"), F.md5("value").alias("_v"),
    ).withColumn("changed", F.col("_f") != F.col("_v")).drop("_f", "_v"))
    several = keyed.groupBy("k").agg(F.max("changed").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("c AND lo <> hi")
    rows = keyed.join(several.select("k"), "k", "left_semi").select("k", "v", "id")
    values = rows.select("k", "v").distinct()
    # different values of a form first, then their rows: rows of one value never meet each other
    apart = values.alias("a").join(values.alias("b"), F.expr("a.k = b.k AND a.v < b.v")).select("a.k", F.col("a.v").alias("v"), F.col("b.v").alias("w"))
    left = apart.join(rows, ["k", "v"]).select("k", F.col("w").alias("v"), F.col("id").alias("one"))
    pairs = left.join(rows, ["k", "v"]).select(F.least("one", "id").alias("key_a"), F.greatest("one", "id").alias("key_b"))
    return pairs.where("key_a < key_b").select(F.lit(tbl).alias("tbl"), "key_a", "key_b")


def look_alike_classes(df: DataFrame, key: str, column: str, scope: str | None = None, tbl: str = "") -> DataFrame:
    """(``tbl``, ``key``, ``class_id``, ``n_rows``, ``n_values``): one row for each row with a value that isn't blank; rows (of the
    same ``scope``) of one consistent form have one class, named by its smallest key, with its rows and different values.

    The compact form of look_alike_pairs: it grows with the table, whatever the size of a class. Only digests are moved;
    rows are counted by value before they are counted by form, each time before the shuffle.
    """
    x = df.select(
        F.col(key).cast("bigint").alias("id"),
        (F.coalesce(F.col(scope).cast("string"), F.lit("\0")) if scope else F.lit("")).alias("scope"), F.col(column).alias("value"),
    )
    form = consistent_form(x, "value", ["id", "scope", "value"], representatives(count_members(x.select("value"))))
    keyed = cut(form.where(F.length(F.regexp_replace("form", r"(?U)\s+", "")) > 0).select(
        "id", F.unhex(F.md5(F.concat_ws("\1", "scope", "form"))).alias("k"), F.unhex(F.md5("value")).alias("v")))
    values = keyed.groupBy("k", "v").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    classes = values.groupBy("k").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_values"))
    return keyed.join(classes, "k").select(F.lit(tbl).alias("tbl"), F.col("id").alias("key"), "class_id", "n_rows", "n_values")


def forms(df: DataFrame, key: str, column: str) -> DataFrame:
    """(``key``, ``form``) of each row: its text in the consistent form, null where it is null. No shuffle."""
    x = df.select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("value"))
    return consistent_form(x, "value", ["key"], representatives(count_members(x.select("value"))))
