"""Dimension, state, sample and page files to tables; small sinks."""

from __future__ import annotations

import json
import time
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yakamoz.functions.text import lookup_key
from yakamoz.operators.tables import first_by
from yakamoz.runtime import exists, write_file

_BOM = "﻿"


def lines(spark: SparkSession, path: str, name: str, header: str | None = None) -> DataFrame:
    """One-column list: trimmed, without blanks, a byte order mark and the header."""
    x = spark.read.text(path).select(F.trim(F.replace("value", F.lit(_BOM), F.lit(""))).alias(name)).where(F.col(name) != "")
    return x.where(F.lower(name) != header.lower()) if header else x


def columns_csv(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """CSV with a header that has the required columns, else ValueError; all columns are text."""
    x = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    x = x.toDF(*[c.replace(_BOM, "").strip() for c in x.columns])
    if missing := [c for c in required if c not in x.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return x


def categories(spark: SparkSession, path: str) -> DataFrame:
    """Distinct categories in the order of the file: the column ``category`` if its head has category and word, else the first column."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(200).collect())[:2048]
    if "category" in head and "word" in head:
        x = columns_csv(spark, path, "category").select(F.trim("category").alias("category"))
    else:
        x = lines(spark, path, "category", "category").select(F.trim(F.split("category", ",")[0]).alias("category"))
    x = x.where("category <> ''").withColumn("_o", F.monotonically_increasing_id())
    return x.groupBy("category").agg(F.min("_o").alias("_o")).orderBy("_o").select("category")


def districts(spark: SparkSession, path: str) -> DataFrame:
    """(province, district), one row for each look-up key within a province, the first in the file; sorted by look-up keys."""
    x = columns_csv(spark, path, "province", "district").select(F.trim("province").alias("province"), F.trim("district").alias("district"))
    bad = lambda c: F.coalesce(F.lower(c), F.lit("")).isin("", "nan")
    x = x.where(~bad("province") & ~bad("district")).withColumns({"_k": lookup_key(F.col("district")), "_o": F.monotonically_increasing_id()})
    return first_by(x, ["province", "_k"], ["_o"]).orderBy(lookup_key(F.col("province")), "province", "_k").drop("_k", "_o")


def state(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct values of a state file; none if the file or the column isn't there."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(column, T.StringType())]))
    if not exists(spark, path):
        return empty
    x = spark.read.option("header", True).csv(path)
    return x.select(column).dropna().distinct() if column in x.columns else empty


def samples(spark: SparkSession, path: str, text: str = "text", label: str = "label", key: str | None = None) -> DataFrame:
    """Labelled samples (entry_id, text, label); blank texts are left out."""
    x = columns_csv(spark, path, text, label)
    out = x.select(
        (F.coalesce(F.trim(key), F.lit("")) if key and key in x.columns else F.lit("")).alias("entry_id"), F.trim(text).alias("text"), F.trim(label).alias("label"))
    return out.where("text IS NOT NULL AND text <> ''")


def json_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a JSON list; none if the file is missing or isn't one."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_tree(spark: SparkSession, root: str, suffix: str, schema: T.StructType) -> DataFrame:
    """Objects of all files below root whose names end so, with ``file``."""
    x = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(root)
    return x.withColumn("file", F.input_file_name())


def write_state(df: DataFrame, path: str, column: str) -> None:
    """Sorted, distinct, with a header."""
    df.select(column).dropna().distinct().orderBy(column).write.mode("overwrite").option("header", True).csv(path)


def add_state(spark: SparkSession, new: DataFrame, path: str, column: str) -> None:
    """The state file with the values of ``new`` too: the union of both sets, each value once."""
    known = state(spark, path, column).select(F.col(column).cast("string"))
    fresh = new.select(F.col(column).cast("string").alias(column)).dropna().distinct().join(known.withColumnRenamed(column, "_k"), F.col(column) == F.col("_k"), "left_anti")
    fresh.write.mode("append").option("header", True).csv(path)


def append_event(spark: SparkSession, path: str, **event: object) -> None:
    """An event of a log: a file of one JSON line in the folder ``path``, so that any file system and any number of writers do."""
    write_file(spark, f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(event, ensure_ascii=False, default=str) + "\n")


class PageSource(Protocol):
    """A source of pages: search results and pages come from outside of the engine as tables. ``sources.web`` has one for the web."""

    def search(self, queries: DataFrame) -> DataFrame:
        """(query, rank, link) of (query, num_results)"""

    def pages(self, urls: DataFrame) -> DataFrame:
        """(url, html) of (url); html null where there is no page"""
