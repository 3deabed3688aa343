"""Roll-ups of sentiment by place, model and category, and classification figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.functions.sentiment import color_score, plain_category, plain_label, ratio, score_label


def by_model(posts: DataFrame, *keep: str) -> DataFrame:
    """One row for each post and model, in one scan: ``keep``, ``model_type``, ``label``, ``score``."""
    x = posts.select(*keep, F.col("sentiment.llm").alias("_l"), F.col("sentiment.transformer").alias("_t"))
    pair = lambda m, c: F.struct(F.lit(m).alias("model_type"), F.col(f"{c}.label").alias("label"), F.col(f"{c}.score").alias("score"))
    x = x.withColumn("_m", F.explode(F.array(pair("llm", "_l"), pair("transformer", "_t"))))
    return x.select(*keep, "_m.model_type", "_m.label", "_m.score")


def province_sentiment(
    posts: DataFrame, start: datetime, end: datetime, keyword: str | None = None, sentiment: str | None = None
) -> DataFrame:
    """Counts, ratios and means of polar posts by province and model, created from start to end inclusive; neutral ones are left out."""
    x = posts.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    x = x.where(F.coalesce(F.col("location.province"), F.lit("")) != "")
    if keyword is not None:
        x = x.where(F.contains(F.lower("text"), F.lower(F.lit(keyword))))
    x = by_model(x.withColumn("province", F.col("location.province")), "province").withColumn("label", F.lower("label"))
    x = x.where(F.col("label").isin("positive", "negative"))
    if sentiment is not None:
        x = x.where(F.col("label") == sentiment)
    g = x.groupBy("province", "model_type").agg(
        F.count("*").alias("total_posts"), F.count_if(F.col("label") == "positive").alias("positive"),
        F.count_if(F.col("label") == "negative").alias("negative"))
    average = ratio(F.col("positive") - F.col("negative"), F.col("total_posts"))
    return g.withColumns({
        "average_sentiment": average, "normalized_score": (average + 1) / 2,
        "positive_ratio": ratio(F.col("positive"), F.col("total_posts")), "negative_ratio": ratio(F.col("negative"), F.col("total_posts")),
    })


def located(posts: DataFrame) -> DataFrame:
    """``province`` and ``district`` with their fallbacks: without a province both Unknown, without a district the province."""
    p, d = (F.coalesce(F.trim(F.col(f"location.{x}")), F.lit("")) for x in ("province", "district"))
    return posts.withColumns({
        "province": F.when(p == "", "Unknown").otherwise(p), "district": F.when(p == "", "Unknown").when(d == "", p).otherwise(d)})


def map_counts(posts: DataFrame) -> DataFrame:
    """Counts and score of positive, neutral and negative posts, by province and by district at once, for each model.
    ``grain`` is province or district; one scan and one grouping."""
    x = by_model(located(posts), "province", "district").withColumn("label", plain_label(F.col("label")))
    x = x.groupingSets([["province", "model_type"], ["province", "district", "model_type"]], "province", "district", "model_type").agg(
        F.grouping("district").alias("_g"), F.count("*").alias("total_posts"), F.count_if(F.col("label") == "positive").alias("positive"),
        F.count_if(~F.col("label").isin("positive", "negative")).alias("neutral"), F.count_if(F.col("label") == "negative").alias("negative"))
    score = color_score(F.col("positive"), F.col("negative"), F.col("total_posts"))
    return x.withColumns({
        "grain": F.when(F.col("_g") == 1, "province").otherwise("district"), "map_color_score": score, "sentiment_label": score_label(F.bround(score, 4)),
    }).drop("_g")


def map_categories(posts: DataFrame, raw: DataFrame) -> DataFrame:
    """As map_counts at province grain, by category too: the first tag of the raw post of the same id."""
    tags = raw.select(F.col("_id").alias("_r"), F.get("post_tags", F.lit(0)).alias("category"))
    x = located(posts).join(tags, F.col("post_id") == F.col("_r"), "left")
    x = by_model(x.withColumn("category", plain_category(F.col("category"))), "province", "category")
    x = x.withColumn("label", plain_label(F.col("label"))).groupBy("province", "model_type", "category").agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == "positive").alias("_p"), F.count_if(F.col("label") == "negative").alias("_n"))
    return x.withColumn("map_color_score", color_score(F.col("_p"), F.col("_n"), F.col("total"))).drop("_p", "_n")


def map_metadata(posts: DataFrame) -> DataFrame:
    x = located(posts)
    return x.agg(
        F.count_if(F.col("province") == "Unknown").alias("unmatched_posts"), F.count_distinct("province").alias("total_provinces"),
        F.count_distinct("province", "district").alias("total_districts"))


def confusion(x: DataFrame, expected: str, predicted: str) -> DataFrame:
    """tp, tn, fp, fn; positive is the positive class."""
    e, p = F.col(expected) == "positive", F.col(predicted) == "positive"
    return x.agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))


def metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 by class and as macro means, of confusion()'s row."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    f1 = lambda p, r: ratio(2 * p * r, p + r)
    x = matrix.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision_positive": ratio(tp, tp + fp), "recall_positive": ratio(tp, tp + fn), "support_positive": tp + fn,
        "precision_negative": ratio(tn, tn + fn), "recall_negative": ratio(tn, tn + fp), "support_negative": tn + fp,
    })
    x = x.withColumns({f"f1_{c}": f1(F.col(f"precision_{c}"), F.col(f"recall_{c}")) for c in ("positive", "negative")})
    return x.withColumns({f"macro_{m}": (F.col(f"{m}_positive") + F.col(f"{m}_negative")) / 2 for m in ("precision", "recall", "f1")})


def step_summary(incoming: DataFrame, existing: DataFrame, cleaned: str, key: str, existing_key: str) -> DataFrame:
    """scanned, processed, skipped_existing, skipped_invalid of an incremental step."""
    known = existing.select(F.col(existing_key).alias("_k")).distinct().withColumn("_old", F.lit(True))
    x = incoming.join(known, F.col(key) == F.col("_k"), "left")
    old = F.col("_old").isNotNull()
    return x.agg(
        F.count("*").alias("scanned"), F.count_if(~old & F.col(cleaned).isNotNull()).alias("processed"), F.count_if(old).alias("skipped_existing"),
        F.count_if(~old & F.col(cleaned).isNull()).alias("skipped_invalid"))
