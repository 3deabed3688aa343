"""The map document: features by province and by district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakamoz.operators.aggregate import map_categories, map_counts, map_metadata
from yakamoz.operators.location import province_code


def _by(first: str, pairs: Column) -> Column:
    """A map of an array of pairs, in the order of their keys."""
    before = lambda a, b: F.when(a[first] < b[first], -1).when(a[first] > b[first], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(pairs, before))


def features(posts: DataFrame, raw: DataFrame) -> DataFrame:
    """(``level``, ``province``, ``district``, ``feature``): a GeoJSON feature as text; geometry is null, district only where there is one."""
    counts = map_counts(posts)
    model = F.struct(
        "total_posts", F.struct("positive", "neutral", "negative").alias("distribution"), F.bround("map_color_score", 4).alias("map_color_score"),
        "sentiment_label")
    per = counts.groupBy("grain", "province", "district").agg(_by("model_type", F.collect_list(F.struct("model_type", model.alias("m")))).alias("models"))
    cats = map_categories(posts, raw).groupBy("province", "model_type").agg(
        _by("category", F.collect_list(F.struct("category", F.struct("total", F.bround("map_color_score", 4).alias("map_color_score")).alias("s")))).alias("c"))
    cats = cats.groupBy("province").agg(_by("model_type", F.collect_list(F.struct("model_type", "c"))).alias("categories"))
    x = per.join(cats.withColumnRenamed("province", "_p"), (F.col("grain") == "province") & (F.col("province") == F.col("_p")), "left")
    own = [F.col("grain").alias("level"), "province", province_code(F.col("province")).alias("province_code")]
    rest = ["models", F.coalesce("categories", F.create_map().cast("map<string,map<string,struct<total:bigint,map_color_score:double>>>")).alias("categories")]
    head = [F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("geometry")]
    keep = {"ignoreNullFields": "false"}
    text = F.when(F.col("grain") == "district", F.to_json(F.struct(*head, F.struct(*own, "district", *rest).alias("properties")), keep)).otherwise(
        F.to_json(F.struct(*head, F.struct(*own, *rest).alias("properties")), keep))
    return x.select(F.col("grain").alias("level"), "province", F.coalesce("district", F.lit("")).alias("district"), text.alias("feature"))


def write_collection(posts: DataFrame, raw: DataFrame, path: str, generated_at: str) -> None:
    """A line of metadata and one line for each feature, written by the tasks."""
    meta = map_metadata(posts).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.struct(
        F.lit(generated_at).alias("generated_at"), "total_provinces", "total_districts", "unmatched_posts").alias("metadata"))).alias("value"))
    meta.unionByName(features(posts, raw).select(F.col("feature").alias("value"))).write.mode("overwrite").text(path)
