"""Keyed tables: skips, merges, first-wins and top-k selections."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yakamoz.runtime import exists, files, hadoop_path, names, read_file, write_file

#: Buckets of a keyed table, unless its creator says otherwise.
BUCKETS = 64


def skip_known(new: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``known``; nothing is collected, the join kind is left to the optimizer."""
    k = known.select(F.col(known_key or key).alias("_k")).distinct()
    return new.join(k, F.col(key) == F.col("_k"), "left_anti")


def known_or_new(new: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """``new`` with ``state``: known for rows whose key is in ``known``, else new. One join gives both sides of a skip."""
    k = known.select(F.col(known_key or key).alias("_k")).distinct().withColumn("state", F.lit("known"))
    return new.join(k, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("state", F.coalesce("state", F.lit("new")))


def only_known(new: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    k = known.select(F.col(known_key or key).alias("_k"))
    return new.join(k, F.col(key) == F.col("_k"), "left_semi")


def first_by(df: DataFrame, by: list[str], order: list[str], unless: Column | None = None) -> DataFrame:
    """The first row of each group in the given order; rows for which ``unless`` holds are all kept. The minimum of an
    aggregate, combined before the shuffle: a group with a third of all rows costs a row a task."""
    rest = [c for c in df.columns if c not in {*by, *order}]
    kept = df.where(~F.coalesce(unless, F.lit(False))) if unless is not None else df
    if not rest and len(order) == 1:  # a plain minimum is aggregated by hash; nulls come first here too
        least = F.when(F.count_if(F.col(order[0]).isNull()) == 0, F.min(order[0])).alias(order[0])
        out = kept.groupBy(*by).agg(least).select(*df.columns)
        return out.unionByName(df.where(unless)) if unless is not None else out
    out = kept.groupBy(*by).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r")).select(*by, "_r.*").select(*df.columns)
    return out.unionByName(df.where(unless)) if unless is not None else out


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a task and group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def merged(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in its place by key; of several new rows of a key the last in order stays."""
    rest = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*old.columns)
    cond = [old[k].eqNullSafe(last[k]) for k in key]
    return old.join(last, cond, "left_anti").unionByName(last)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that aren't unique, with their number of rows: empty if the index holds."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def _bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _version(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and manifest of a table's newest version; (0, None) for a folder of plain Parquet files or none."""
    last = max((x for x in names(spark, f"{path}/versions") if x.endswith(".json")), default=None)
    return (int(last[:-5]), json.loads(read_file(spark, f"{path}/versions/{last}"))) if last else (0, None)


def read_table(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The newest version of a keyed table, or of it the buckets ``only``; plain Parquet folders are read as they are."""
    _, m = _version(spark, path)
    if m is None:
        return spark.read.parquet(path)
    schema = T.StructType.fromJson(m["schema"])
    folders = [f"{path}/{f}" for b, f in sorted(m["folders"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, path: str, rows: DataFrame, key: list[str], n: int, kept: dict[str, str]) -> None:
    """Write ``rows`` by bucket, then a manifest that names their folders and the ``kept`` ones. The manifest's appearance is the
    change: before it readers have the old version whole, after it the new one; a crash or a second writer leaves the old."""
    number, old = _version(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    rows.withColumn("_b", _bucket(key, n)).hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{path}/{folder}")
    new = {x.split("=")[1]: f"{folder}/{x}" for x in names(spark, f"{path}/{folder}") if x.startswith("_b=")}
    manifest = {"buckets": n, "key": key, "schema": rows.schema.jsonValue(), "folders": kept | new}
    write_file(spark, f"{path}/versions/{number + 1:012d}.json", json.dumps(manifest))
    fs = files(spark, path)
    before = set(old["folders"].values()) if old else set()
    used = {f.split("/")[0] for f in {*manifest["folders"].values(), *before}}  # the version before stays for its readers
    for x in names(spark, path):
        if (x.startswith("data-") and x not in used) or (old is None and x.startswith("part-")):
            fs.delete(hadoop_path(spark, f"{path}/{x}"), True)
    for x in sorted(names(spark, f"{path}/versions"))[:-2]:
        fs.delete(hadoop_path(spark, f"{path}/versions/{x}"), False)


def replace_table(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """A new version of the whole table: ``df`` may read the one that it replaces."""
    spark = df.sparkSession
    _, m = _version(spark, path)
    _commit(spark, path, df, key, m["buckets"] if m else buckets, {})


def upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Merge into the keyed table at ``path``, which may not exist yet. Rows lie in buckets by a hash of their key; only buckets that
    the new rows fall into are read and written again, the others stay where they are. ``buckets`` counts for a new table."""
    _, m = _version(spark, path)
    n = m["buckets"] if m else buckets
    touched = {r[0] for r in new.select(_bucket(key, n)).distinct().collect()}  # n numbers at most
    if m is None:
        base, kept = (spark.read.parquet(path) if exists(spark, path) else new.limit(0)), {}
    elif not touched:
        return
    else:
        base, kept = read_table(spark, path, touched), {b: f for b, f in m["folders"].items() if int(b) not in touched}
    _commit(spark, path, merged(base, new, key, order), key, n, kept)


def with_prediction(posts: DataFrame, predictions: DataFrame, model: str, key: str = "post_id") -> DataFrame:
    """``sentiment.<model>`` set to the prediction (key, label, score, model) where there is one."""
    p = predictions.select(F.col(key).alias("_k"), F.struct("label", "score", "model").alias("_p"))
    x = posts.join(p, F.col(key) == F.col("_k"), "left")
    x = x.withColumn("sentiment", F.col("sentiment").withField(model, F.coalesce("_p", F.col(f"sentiment.{model}"))))
    return x.drop("_k", "_p")


def pending(posts: DataFrame, model: str, *models: str) -> DataFrame:
    """(post_id, text) of posts with a text whose label of ``model`` is pending or neutral or comes from one of ``models``."""
    m = F.col(f"sentiment.{model}")
    hit = (m["model"] == "pending") | (m["label"] == "neutral")
    if models:
        hit = hit | m["model"].isin(*models)
    return posts.where(F.col("text").isNotNull() & (F.col("text") != "") & hit).select("post_id", "text")


def untagged(posts: DataFrame, limit: int = 0) -> DataFrame:
    """Posts without a province; at most ``limit`` if it isn't 0."""
    x = posts.where(F.col("location.province").isNull() | (F.col("location.province") == ""))
    return x.limit(limit) if limit else x
