"""Column functions on records: dates, identifiers, fingerprints, tags."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from yakamoz.functions.text import collapse

# Date notations in the order in which they are tried.
NOTATIONS = (
    "d.M.yyyy H:m", "d.M.yyyy H:m:s", "d.M.yyyy", "d/M/yyyy H:m", "d/M/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
)
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}){0,2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$|^\d{4}-\d{2}-\d{2}$"


def parse_date(c: Column) -> Column:
    """Timestamp of the first notation that fits, else of ISO 8601, to the second; null if none does."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, " ?tarihinde", ""), r"(?U)\s+", " "))
    iso = F.date_trunc("second", F.when(t.rlike(_ISO), F.try_to_timestamp(t)))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(n)) for n in NOTATIONS], iso)


def post_key(source: Column, topic: Column, entry: Column, page: Column, text: Column) -> Column:
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (source, topic, entry, page)]
    return F.sha1(F.concat_ws("|", *parts, F.trim(F.coalesce(text, F.lit("")))))


def dedupe_form(c: Column) -> Column:
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def fingerprint(c: Column) -> Column:
    # the digest of '' gives way to ''; so the form is named, and made, once
    return F.regexp_replace(F.sha1(dedupe_form(c)), f"^{hashlib.sha1(b'').hexdigest()}$", "")


def tag(tags: Column, i: int) -> Column:
    """Tag at a position (from 0), trimmed; '' if there is none."""
    return F.coalesce(F.trim(F.get(tags, F.lit(i))), F.lit(""))


def build_tags(*parts: Column) -> Column:
    """The parts that aren't blank, trimmed, in order."""
    return F.filter(F.array(*[F.trim(p) for p in parts]), lambda x: x.isNotNull() & (x != ""))


def issues(text: Column, source: Column, language: Column, created: Column, fallback: Column, category: Column, province: Column,
           district: Column, level: Column, min_text: int = 15) -> Column:
    """Ordered names of what a record lacks; empty for a good one."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    flag = lambda on, name: F.when(on, F.lit(name))
    body = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.array_compact(F.array(
        F.when(body == 0, "missing_text").when(body < min_text, "text_too_short"),
        flag(blank(source), "missing_source"), flag(blank(language), "missing_language"), flag(created.isNull(), "missing_created_at"),
        flag(fallback, "fallback_timestamp_used"), flag(blank(category), "missing_category"), flag(blank(province), "missing_province"),
        flag((level == "district") & blank(district), "missing_district"),
    ))


def is_valid(found: Column) -> Column:
    return F.size(F.array_except(found, F.array(F.lit("fallback_timestamp_used")))) == 0
