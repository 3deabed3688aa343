"""Copies hidden by formatting: Merkle digests of records whose leaves are normalised.

A post is a tree. One that is written wholly as fields of label and value is an unordered node: its children are fields
(an ordered pair of a leaf and a value) and its digest is that of their sorted digests. A value in brackets that is written
as fields is such a node again, to any depth. Any other text is a leaf. Leaves keep letters, digits and emoji of the
consistent form, in lower case, with all letters i as one. Digests go bottom-up. Rows group by root digest; the rows of a
group are compared in full with its first row. Which member of a look-alike class stays plays no part in what is equal, so
the classes' fixed representatives do and no counts of the corpus are needed.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.llm.lookalikes import plain_rewriter
from yakamoz.runtime import cut

#: Texts with fewer letters and digits are no copies of anything.
LEAST = 10
#: Nodes within each other; a value deeper than that is a leaf.
MAX_DEPTH = 200
#: A label has a letter; the sign after it is neither that of a time or a ratio nor of an address.
_FIELD = re.compile(r"[\W_]*([^\W\d_](?:[^:=]|(?<=\d):(?=\d)|:(?=//))*?)(?:(?<!\d):(?!//)|:(?![\d/])|=)(.*\S.*)", re.S)
_OPEN, _CLOSE = "([{", ")]}"
_SEPARATORS = frozenset("|;\r\n\v\f\x85\u2028\u2029")


@lru_cache(1 << 16)
def _kept(ch: str) -> str:
    """'' for white space, punctuation and other signs, else the character."""
    kind = unicodedata.category(ch)
    return ch if kind[0] in "LNM" or kind == "So" or 0x1F3FB <= ord(ch) <= 0x1F3FF else ""


class _Keep(dict):
    def __missing__(self, cp: int) -> str:
        self[cp] = out = _kept(chr(cp))
        return out


_KEEP = _Keep()


def leaf(text: str) -> str:
    """Letters, digits and emoji in lower case; i, ı, İ and I are one letter, other accents count."""
    low = text.replace("İ", "i").replace("I", "i").lower().replace("ı", "i").replace("i̇", "i")
    return low.translate(_KEEP)


def _parts(text: str) -> list[str]:
    """Between separators that stand outside of brackets; brackets that don't match count as signs."""
    depth, at, out, open_ = 0, 0, [], []
    for i, c in enumerate(text):
        if c in _OPEN:
            open_.append(c)
        elif c in _CLOSE:
            if not open_ or _OPEN.index(open_.pop()) != _CLOSE.index(c):
                open_ = None
                break
        elif c in _SEPARATORS and not open_:
            out.append(text[at:i])
            at = i + 1
    if open_ is None or open_:
        return [p for p in "".join("\n" if c in _SEPARATORS else c for c in text).split("\n") if p.strip()]
    return [p for p in (*out, text[at:]) if p.strip()]


def fields(text: str, least: int = 2) -> list[tuple[str, str]] | None:
    """(label, value) of a text that consists of ``least`` or more fields and nothing else, in its order; else None."""
    if ":" not in text and "=" not in text:
        return None
    parts = _parts(text)
    if len(parts) < least:
        return None
    out = []
    for p in parts:
        if not (m := _FIELD.fullmatch(p.strip())) or not leaf(m[1]):
            return None
        out.append((leaf(m[1]), m[2]))
    return out


def _digest(tag: bytes, *children: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join((tag, *children)), digest_size=16).digest()


def tree(text: str) -> tuple[bytes, str]:
    """Root digest and the whole normalised record, in the order in which digests were sorted."""
    return _node(text, fields(text))


def _node(text: str, got: list[tuple[str, str]] | None, depth: int = 0) -> tuple[bytes, str]:
    if got is None:
        s = leaf(text)
        return _digest(b"text", s.encode()), s
    nodes = []
    for label, value in got:
        v = value.strip()
        inner = fields(v[1:-1], 1) if depth < MAX_DEPTH and len(v) > 2 and v[0] in _OPEN and v[-1] == _CLOSE[_OPEN.index(v[0])] else None
        digest, record = _node(value, inner, depth + 1)
        nodes.append((_digest(b"field", _digest(b"text", label.encode()), digest), f"{label}\1{record}"))
    nodes.sort()
    return _digest(b"fields", *(n[0] for n in nodes)), "\3" + "\2".join(r for _, r in nodes) + "\4"


def records(df: DataFrame, key: str, column: str, short: bool = False) -> DataFrame:
    """(``id``, ``root``, ``record``) of every row with at least LEAST letters and digits; with ``short`` of the others too, whose
    root and record are null."""
    x = df.select(F.col(key).cast("bigint").alias("id"), F.col(column).alias("text"))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = plain_rewriter()
        for b in batches:
            ids, roots, recs = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = rec = None
                if t is not None and len(t) >= LEAST and sum(map(str.isalnum, t := f(t))) >= LEAST:
                    root, rec = tree(t)
                if root or short:
                    ids.append(i)
                    roots.append(root)
                    recs.append(rec)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.binary()), pa.array(recs, pa.string())], ["id", "root", "record"])

    return x.mapInArrow(build, "id bigint, root binary, record string")


def copies(df: DataFrame, key: str = "_id", column: str = "text") -> DataFrame:
    """(``first_id``, ``copy_id``): for each group of equal records a row for every row but the one with the smallest key.

    The digest groups are aggregated before the shuffle, so that a group with a third of all rows arrives as one row per
    task; the join back splits hot groups by adaptive execution. Rows whose record differs from the first one's despite an
    equal digest are left out. Null, empty and very short texts are in no group; very long ones are hashed whole; an empty
    table gives an empty result; further columns are ignored.
    """
    own = cut(records(df, key, column))
    groups = own.groupBy("root").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min_by("record", "id").alias("first")).where("n > 1")
    rows = own.join(groups, "root").where("id <> first_id AND record = first")
    return rows.select("first_id", F.col("id").alias("copy_id"))


def collapsed(df: DataFrame, key: str = "_id", column: str = "text", short: bool = False) -> DataFrame:
    """(``first_id``, ``n_copies``): one row for each distinct record, compared in full, with the number of rows that hold it.

    With ``short`` each null, empty or very short text, which is no copy of anything, is a record of its own with ``n_copies``
    1, so that ``n_copies`` adds up to the rows of ``df``; without it such rows have no record.
    """
    own = records(df, key, column, short)
    own = cut(own) if short else own
    groups = own.where("root IS NOT NULL").groupBy("root", "record").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies")).select("first_id", "n_copies")
    return groups.union(own.where("root IS NULL").select("id", F.lit(1).cast("bigint"))) if short else groups
