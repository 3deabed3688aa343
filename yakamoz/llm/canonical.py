"""Freely typed values mapped to the entries of a reference list.

Distinct values are resolved once each: normalised, matched through an inverted index of character n-grams, scored by
weighted cosine and accepted above a threshold and a margin to the next entry. A district is searched among those of the
province that the same row means. Rows get their entry by a join with the distinct values.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakamoz.llm.lookalikes import plain_rewriter

#: Least cosine, and least lead over the next entry.
THRESHOLD, MARGIN = 0.33, 0.04
#: Entries of a reference list that may be broadcast: about 400 bytes each; a distinct value takes 0.1 ms at 250 entries, 3 ms at 50,000, 11 ms at 200,000.
MAX_ENTRIES = 200_000
# Words around a name that aren't part of it (province, district, centre, and so on, category, topic).
NOISE = frozenset("il ili ilce ilcesi merkez merkezi sehri da de ta te vb vs kategorisi kategori konu".split())
KINDS = ("category", "province", "district")
_MOJIBAKE = re.compile("[ÃÄÅÂâ][\u0080-¿]")
_VOWELS = re.compile("[aeiou]")


def repaired(value: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again."""
    for codec in ("latin-1", "cp1252"):
        if not _MOJIBAKE.search(value) and codec == "latin-1":
            continue
        try:
            return value.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return value


def folded(value: str) -> str:
    """Lower case without accents, signs and look-alikes, words apart by one blank."""
    v = plain_rewriter()(repaired(value)).replace("İ", "i").replace("I", "i").lower().replace("ı", "i")
    v = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", v))


def grams(word: str) -> Counter:
    """Character n-grams: pairs, triples, pairs with a gap, pairs in either order, and those of the consonants."""
    s = f"^{word}$"
    bones = f"^{_VOWELS.sub('', word)}$"
    out = Counter(s[i : i + 2] for i in range(len(s) - 1))
    out.update(s[i : i + 3] for i in range(len(s) - 2))
    out.update(f"{s[i]}_{s[i + 2]}" for i in range(len(s) - 2))
    out.update("".join(sorted(s[i : i + 2])) + "~" for i in range(1, len(s) - 2))
    out.update(f"{bones[i : i + 2]}!" for i in range(len(bones) - 1))
    return out


class Places:
    """Inverted index over (id, kind, province, name): made once on the driver, in flat arrays."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.exact: dict[tuple[str, str], list[int]] = defaultdict(list)
        number: dict[str, int] = {}
        gram, entry, times = [], [], []
        for k, (_, kind, _, name) in enumerate(rows):
            f = folded(name).replace(" ", "")
            self.exact[kind, f].append(k)
            for g, n in grams(f).items():
                gram.append(number.setdefault(g, len(number)))
                entry.append(k)
                times.append(n)
        self.number, self.rare = number, math.log((len(rows) + 1) / 0.5)
        g, e = np.array(gram, dtype=np.int64), np.array(entry, dtype=np.int64)
        count = np.bincount(g, minlength=len(number))
        self.weight = np.log((len(rows) + 1) / (count + 0.5))
        v = np.array(times, dtype=float) * self.weight[g]
        v /= np.sqrt(np.bincount(e, v * v, minlength=len(rows)))[e]
        order = np.argsort(g, kind="stable")
        self.start, self.entry, self.value = np.concatenate([[0], np.cumsum(count)]), e[order].astype(np.int32), v[order].astype(np.float32)
        self.kind = {kind: np.array([k for k, r in enumerate(rows) if r[1] == kind], dtype=int) for kind in KINDS}
        of: dict[str, list[int]] = defaultdict(list)
        for k, r in enumerate(rows):
            if r[1] == "district":
                of[r[2]].append(k)
        self.districts = {p: np.array(x) for p, x in of.items()}
        self.known: dict[str, int | None] = {}

    def scores(self, word: str, among: np.ndarray) -> np.ndarray:
        """Cosines of the word and the entries ``among``: the postings of its n-grams, added up by entry."""
        own = grams(word)
        weight = np.array([n * (self.rare if (k := self.number.get(g)) is None else self.weight[k]) for g, n in own.items()])
        ids = np.array([self.number.get(g, -1) for g in own], dtype=np.int64)
        known = ids >= 0
        ids, w = ids[known], (weight / math.sqrt(float(weight @ weight)))[known]
        size = self.start[ids + 1] - self.start[ids]
        at = np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.entry[at], np.repeat(w, size) * self.value[at], minlength=len(self.rows))[among]

    def best(self, value: str, kind: str, among: np.ndarray) -> int | None:
        """Row of the entry that the value names; entries of one name count as one and are accepted only if there is one."""
        if not len(among):
            return None
        f = folded(value)
        words = [w for w in f.split() if w not in NOISE] or f.split()
        variants = dict.fromkeys(["".join(words), *(words if kind != "category" and len(words) > 1 else [])])
        hits = {k for v in variants for k in self.exact.get((kind, v), ()) if among[min(np.searchsorted(among, k), len(among) - 1)] == k}
        if len(hits) == 1:
            return hits.pop()
        score = np.zeros(len(among))
        for v in variants:
            if v:
                score = np.maximum(score, self.scores(v, among))
        top = int(score.argmax())
        lead = score[top] - max(score[:top].max(initial=0.0), score[top + 1 :].max(initial=0.0))
        return int(among[top]) if score[top] >= THRESHOLD and lead >= MARGIN else None

    def province(self, value: str | None) -> int | None:
        if not value or not value.strip():
            return None
        if value not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[value] = self.best(value, "province", self.kind["province"])
        return self.known[value]

    def resolve(self, pos: int, value: str, province: str | None) -> int:
        """place_id of a typed value, 0 for none. Without a province that is an entry, districts of all are searched."""
        kind = KINDS[pos]
        among = self.kind[kind]
        if kind == "province":
            k = self.province(value)
        else:
            if kind == "district" and (p := self.province(province)) is not None:
                among = self.districts.get(self.rows[p][3], np.array([], dtype=int))
            k = self.best(value, kind, among)
        return 0 if k is None else self.rows[k][0]


def typed_values(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``pos``, ``value``, ``in_province``): one row for each value that isn't null or blank."""

    def entry(pos: int, value: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), value.alias("value"))

    def rows(df: DataFrame, src: str, key: str, values: list[Column], province: Column) -> DataFrame:
        x = df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("rec_id"), province.alias("in_province"), F.explode(F.array(*values)).alias("e"))
        return x.select("src", "rec_id", "e.pos", "e.value", F.coalesce(F.when(F.col("e.pos") == 2, F.col("in_province")), F.lit("")).alias("in_province"))

    tag = lambda i: F.get("post_tags", F.lit(i))
    a = rows(raw, "posts_raw", "_id", [entry(i, tag(i)) for i in range(3)], tag(1))
    b = rows(processed, "posts_processed", "post_id", [entry(1, F.col("location.province")), entry(2, F.col("location.district"))], F.col("location.province"))
    return a.unionByName(b).where(F.length(F.regexp_replace("value", r"(?U)\s", "")) > 0)


def mapped(raw: DataFrame, processed: DataFrame, places: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``pos``, ``place_id``): for each typed value that isn't exactly an entry's name of its kind the entry it
    names, or 0.

    Null and blank values give no row, short arrays only what they hold, arrays beyond three values nothing more; repeated
    rows give repeated rows; very long values are compared whole; empty tables give an empty result; other columns are
    ignored. Values equal by score (ties) are unmatched. More than MAX_ENTRIES places: ValueError.
    """
    entries = places.select(F.col("place_id").cast("int"), "kind", "province", "name").where("kind IS NOT NULL AND name IS NOT NULL")
    got = [tuple(r) for r in entries.dropDuplicates(["place_id"]).limit(MAX_ENTRIES + 1).collect()]
    if len(got) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} places")
    shared = raw.sparkSession.sparkContext.broadcast(Places(sorted(got, key=repr)))
    kinds = F.element_at(F.array(*map(F.lit, KINDS)), F.col("pos") + 1)
    names = F.broadcast(entries.select(F.col("kind").alias("_k"), F.col("name").alias("_n")).distinct())  # at most MAX_ENTRIES
    odd = typed_values(raw, processed).join(names, (kinds == F.col("_k")) & (F.col("value") == F.col("_n")), "left_anti")

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            ids = [index.resolve(*x) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int32())], [*b.schema.names, "place_id"])

    # spread by number, not by bytes: a resolved value costs far more time than space
    spark = raw.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct = odd.select("pos", "value", "in_province").distinct().repartition(tasks, "value", "in_province")
    to = distinct.mapInArrow(look_up, "pos int, value string, in_province string, place_id int")
    return odd.join(to, ["pos", "value", "in_province"]).select("src", "rec_id", "pos", "place_id")
