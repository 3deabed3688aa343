"""The request language: texts and flags to requests, requests to tasks."""

from __future__ import annotations

import ast
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yakamoz.functions.text import composite_key, is_all, lookup_key, search_query
from yakamoz.operators.tables import skip_known, top_by
from yakamoz.runtime import at_most

#: Rows of a dimension table that may be broadcast.
MAX_NAMES = 100_000

#: Tasks above which a request must be confirmed; results asked for by level.
BULK, RESULTS = 100, {"district": 5, "province": 10}
_WORDS = {"true": True, "false": False, "null": None, "none": None}


def scalar(token: str) -> Any:
    """bool, None, int or text of a token; quotes are dropped."""
    t = token.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.lower() in _WORDS:
        return _WORDS[t.lower()]
    return int(t) if re.fullmatch(r"[+-]?\d+", t) else t


def _split(text: str) -> list[str]:
    """At commas outside of brackets and quotes."""
    parts, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{(":
            depth += 1
        elif c in "]})":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p for p in (*parts, text[at:]) if p.strip()]


def _loose(text: str) -> Any:
    t = text.strip()
    if t.startswith("{") and t.endswith("}"):
        out = {}
        for part in _split(t[1:-1]):
            k, colon, v = part.partition(":")
            if not colon:
                raise ValueError(f"no value: {part.strip()}")
            out[str(scalar(k))] = _loose(v)
        return out
    if t.startswith("[") and t.endswith("]"):
        return [_loose(p) for p in _split(t[1:-1])]
    return scalar(t)


def parse_input(value: Any) -> Any:
    """A request from JSON, a Python literal or a loosely written object; other values stay; '' is no request."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if not text:
        return {}
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError):
            continue
    got = _loose(text)
    if not isinstance(got, dict):
        raise ValueError("not a request")
    return got


def requests_of(value: Any) -> list[dict] | None:
    """The list in ``requests``, or the object itself if it isn't empty; else None: nothing was asked for."""
    got = parse_input(value)
    if not isinstance(got, dict) or not got:
        return None
    if "requests" in got and not isinstance(got["requests"], list):
        raise ValueError("requests must be a list")
    return list(got["requests"]) if "requests" in got else [got]


#: Columns of a request as a row.
REQUEST = "request_id string, level string, province string, district string, category string, num_results int, max_topics int"


def request_rows(spark: SparkSession, asked: list[dict]) -> DataFrame:
    """Requests as rows: what a driver was asked for, few by nature."""
    text = lambda r, c: None if r.get(c) is None else str(r[c])
    number = lambda r, c: None if r.get(c) in (None, "") else int(r[c])
    rows = [(str(r.get("request_id", i)), *(text(r, c) for c in ("level", "province", "district", "category")), number(r, "num_results"), number(r, "max_topics"))
            for i, r in enumerate(asked)]
    return spark.createDataFrame(rows, REQUEST)


def every_request(include_provinces: bool = False) -> list[dict]:
    """All districts and categories, also all provinces if wanted: asked for outright, never by an empty request."""
    return [{"level": "province", "category": "all"}] * include_provinces + [{"level": "district", "district": "all", "category": "all"}]


def request_of_flags(**flags: Any) -> dict:
    """Flags that were given, as a request; a level alone asks for nothing."""
    got = {k: v for k, v in flags.items() if v is not None and v is not False and v != ""}
    return got if set(got) - {"level"} else {}


def unknown_names(requests: DataFrame, provinces: DataFrame, districts: DataFrame) -> DataFrame:
    """(``request_id``, ``what``, ``name``): provinces that requests name and no list has, and districts that none of the request's
    provinces has."""
    r = requests.where(~_blank("province") & ~is_all(F.col("province")))
    p = provinces.select(lookup_key(F.col("province")).alias("_pk")).distinct()
    bad = r.join(F.broadcast(p), F.col("_pk") == lookup_key(F.col("province")), "left_anti").select("request_id", F.lit("province").alias("what"), F.col("province").alias("name"))
    d = districts.select(lookup_key(F.col("province")).alias("_dp"), lookup_key(F.col("district")).alias("_dk")).distinct()
    on = (F.col("_dk") == lookup_key(F.col("district"))) & (_blank("province") | is_all(F.col("province")) | (F.col("_dp") == lookup_key(F.col("province"))))
    r = requests.where(~_blank("district") & ~is_all(F.col("district")) & (_level() == "district"))
    return bad.unionByName(r.join(F.broadcast(d), on, "left_anti").select("request_id", F.lit("district").alias("what"), F.col("district").alias("name")))


def known_names(requests: DataFrame, provinces: DataFrame, districts: DataFrame) -> DataFrame:
    """``requests``, or ValueError with the first names that no list has."""
    if bad := unknown_names(requests, provinces, districts).orderBy("request_id", "what").limit(5).collect():
        raise ValueError("unknown " + ", ".join(f"{r.what} {r.name!r}" for r in bad))
    return requests


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _level() -> Column:
    return F.when(_blank("level") | (F.lower("level") == "auto"), F.when(_blank("district"), "province").otherwise("district")).otherwise(F.lower("level"))


def expand(requests: DataFrame, provinces: DataFrame, districts: DataFrame, categories: DataFrame) -> DataFrame:
    """Tasks of requests (``request_id``, ``level``, ``province``, ``district``, ``category``, ``num_results``, ``max_topics``).

    Without a level a request is for districts if it names one, else for provinces; all, hepsi and * stand for every value,
    so does a missing province or category; names match by look-up key, categories may be free text. A name that isn't known
    gives no tasks here: known_names() raises for it. The dimension tables are broadcast, MAX_NAMES rows each at most; the
    product of requests and names is the feature.
    """
    any_ = lambda c: _blank(c) | is_all(F.col(c))
    provinces, districts, categories = (at_most(x, MAX_NAMES, "names of places or categories") for x in (provinces, districts, categories))
    r = requests.withColumns({"_level": _level(), "_ap": any_("province"), "_ad": any_("district"), "_ac": any_("category")})
    p = provinces.select(F.col("province").alias("_p"), lookup_key(F.col("province")).alias("_pk"))
    d = districts.select(F.col("province").alias("_dp"), F.col("district").alias("_d"), lookup_key(F.col("district")).alias("_dk"))
    c = categories.select(F.col("category").alias("_c"))
    x = r.join(F.broadcast(p), F.col("_ap") | (F.col("_pk") == lookup_key(F.col("province"))))
    on = (F.col("_level") == "district") & (F.col("_dp") == F.col("_p")) & (F.col("_ad") | (F.col("_dk") == lookup_key(F.col("district"))))
    x = x.join(F.broadcast(d), on, "left").where((F.col("_level") == "province") | F.col("_d").isNotNull())
    x = x.join(F.broadcast(c), F.col("_ac"), "left")
    default = F.when(F.col("_level") == "district", RESULTS["district"]).otherwise(RESULTS["province"])
    return x.select(
        "request_id", F.col("_level").alias("level"), F.col("_p").alias("province"), F.col("_d").alias("district"),
        F.coalesce("_c", F.trim("category")).alias("category"), F.coalesce("num_results", default).alias("num_results"), "max_topics",
    )


def keyed(tasks: DataFrame, site: str) -> DataFrame:
    """Tasks with their search ``query``, ``fetch_key`` and ``request_key``."""
    p, d, c = F.col("province"), F.col("district"), F.col("category")
    return tasks.withColumns({
        "query": search_query(site, p, d, c), "fetch_key": F.concat_ws(" | ", p, F.nullif(d, F.lit("")), c),
        "request_key": composite_key(F.col("level"), p, d, c)})


def guarded(tasks: DataFrame, confirm_bulk: bool = False) -> DataFrame:
    """``tasks``, or ValueError if there are none or too many without confirmation; counts no more than it must."""
    n = tasks.limit(BULK + 1).count()
    if not n:
        raise ValueError("no tasks")
    if n > BULK and not confirm_bulk:
        raise ValueError(f"more than {BULK} tasks need confirm_bulk")
    return tasks


def open_topics(topics: DataFrame, done: DataFrame, k: int | None = None) -> DataFrame:
    """Per request the first topics by rank that weren't done: (``request_key``, ``rank``, ``topic_url``). As many as the request's
    own ``max_topics``, if there is such a column with a number, else k, else all."""
    x = skip_known(topics, done, "topic_url")
    own = F.col("max_topics") if "max_topics" in x.columns else F.lit(None).cast("int")
    most = F.coalesce(F.when(own > 0, own), F.lit(k))
    if "max_topics" not in x.columns and k is not None:
        return top_by(x, ["request_key"], [F.col("rank"), F.col("topic_url")], k)
    n = F.row_number().over(W.partitionBy("request_key").orderBy("rank", "topic_url"))
    return x.withColumn("_n", n).where(most.isNull() | (F.col("_n") <= most)).drop("_n")
