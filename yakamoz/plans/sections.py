"""Raw, clean and invalid records as tables in buckets of level, province, district and category, and their merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakamoz.functions.text import slug
from yakamoz.operators.tables import first_by
from yakamoz.runtime import exists

SECTIONS = ("raw", "clean", "invalid")
BUCKET = ("level", "province", "district", "category")


def bucketed(records: DataFrame) -> DataFrame:
    """With the names of the bucket's folders; a record of a province has none for a district."""
    own = (F.col("level") == "district") & (F.coalesce(F.trim("district"), F.lit("")) != "")
    return records.withColumns({
        "province_slug": slug(F.col("province")), "district_slug": F.when(own, slug(F.col("district"))).otherwise("all"), "category_slug": slug(F.col("category"))})


def split(records: DataFrame, known: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """Section -> the rows of ``records`` (``post_id``, ``is_valid``, the columns of BUCKET) that are new there: raw ones that their bucket
    doesn't hold yet, and of those the valid ones new to clean, the others new to invalid. Records without an id are left out.
    One column says for each row what it is, from one join with each table's keys."""
    keys = ["post_id", *BUCKET]
    x = records.where(F.coalesce("post_id", F.lit("")) != "")
    for s in SECTIONS:
        t = known.get(s)
        if t is None:
            x = x.withColumn(f"_in_{s}", F.lit(False))
            continue
        k = t.select(*[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in keys]).distinct().withColumn("_hit", F.lit(True))
        x = x.join(k, [F.coalesce(F.col(c), F.lit("")) == F.col(f"_{c}") for c in keys], "left")
        x = x.withColumn(f"_in_{s}", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{c}" for c in keys])
    good = F.coalesce("is_valid", F.lit(False))
    fresh = {"raw": ~F.col("_in_raw"), "clean": ~F.col("_in_raw") & good & ~F.col("_in_clean"), "invalid": ~F.col("_in_raw") & ~good & ~F.col("_in_invalid")}
    return {s: x.where(on).drop(*[f"_in_{t}" for t in SECTIONS]) for s, on in fresh.items()} | {"duplicates": x.where("_in_raw")}


def export(spark: SparkSession, records: DataFrame, root: str) -> dict[str, int]:
    """Append the new rows of each section to its table below ``root`` and count them; rows whose bucket holds them already count as
    skipped duplicates."""
    at = {s: f"{root.rstrip('/')}/{s}" for s in SECTIONS}
    known = {s: spark.read.parquet(p) if exists(spark, p) else None for s, p in at.items()}
    parts = split(bucketed(records), known)
    counts = {("duplicates_skipped" if s == "duplicates" else f"new_{s}_posts"): df.count() for s, df in parts.items()}
    for s in reversed(SECTIONS):  # raw last: what it holds is skipped by a run that starts again
        parts[s].write.mode("append").partitionBy("province_slug", "district_slug").parquet(at[s])
    return counts


def merged(section: DataFrame, scope: str = "all", order: str = "collected_at") -> DataFrame:
    """A section's records without their buckets: each id once, the first by ``order``. ``scope`` is all, province or district: once over
    all, once within each province, or once within each district (records of provinces by themselves)."""
    within = {"all": [], "province": ["province_slug"], "district": ["province_slug", "district_slug"]}[scope]
    x = section.where(F.coalesce("post_id", F.lit("")) != "")
    return first_by(x, ["post_id", *within], [order, "category_slug", "district_slug", "province_slug"] if not within else [order, "category_slug"])
