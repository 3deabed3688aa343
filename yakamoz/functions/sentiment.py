"""Column functions on sentiment labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def color_score(positive: Column, negative: Column, total: Column) -> Column:
    """((positive - negative) / total + 1) / 2; 0.5 without any. Unrounded; round for display only, half-even."""
    return F.coalesce((F.try_divide((positive - negative).cast("double"), total.cast("double")) + 1) / 2, F.lit(0.5))


def score_label(score: Column) -> Column:
    return F.when(score >= 0.6, "positive").when(score <= 0.4, "negative").otherwise("neutral")


def plain_label(c: Column) -> Column:
    """Lower case, trimmed; null and '' are neutral."""
    return F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("neutral"))))


def plain_category(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("uncategorized"))))


def classifier_label(label: Column, score: Column) -> Column:
    """positive or negative of a two-class model's raw label; by score where the label says neither."""
    x = F.lower(F.trim(label))
    by_score = F.when(score >= 0.5, "positive").otherwise("negative")
    return (
        F.when(x.contains("negative") | (x == "label_0"), "negative").when(x.contains("positive") | (x == "label_1"), "positive").otherwise(by_score)
    )


def generated_label(text: Column, fallback: Column) -> Column:
    """struct<label, score> of a generated answer: the first word, else any word, else the fallback score."""
    x = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(?s)<think>.*?</think>", ""))
    first = F.split(x, r"\s+")[0]
    pick = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
    rest = F.when(fallback >= 0.5, pick("positive", 0.5)).otherwise(pick("negative", 0.5))
    return (
        F.when(first.contains("neg"), pick("negative", 0.9)).when(first.contains("pos"), pick("positive", 0.9))
        .when(x.contains("neg"), pick("negative", 0.75)).when(x.contains("pos"), pick("positive", 0.75)).otherwise(rest)
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
