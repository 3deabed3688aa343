"""Steps run in order over tables of one root folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakamoz.functions.records import tag
from yakamoz.functions.text import clean_text
from yakamoz.operators.aggregate import province_sentiment, step_summary
from yakamoz.operators.classify import ERRORS, Model, evaluated, first_errors, hardest_errors, lexicon, scores_of
from yakamoz.operators.location import tagged
from yakamoz.operators.tables import pending, read_table, replace_table, skip_known, untagged, upsert, with_prediction
from yakamoz.plans import fetch as fetching
from yakamoz.plans.geojson import write_collection
from yakamoz.runtime import exists, write_file
from yakamoz.sources.readers import PageSource, samples

#: Rows of a report's samples.
SAMPLE = 500


@dataclass
class Context:
    """What steps share: the session, the folder of the tables, the time of the run, the classifiers and the source of pages."""

    spark: SparkSession
    root: str
    run_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0))
    models: dict[str, Model] = field(default_factory=lambda: {"transformer": Model(lexicon, "lexicon"), "llm": Model(lexicon, "lexicon", batch=8, generates=True)})
    pages: PageSource | None = None
    site: str = "forum.example"

    def path(self, name: str) -> str:
        """In the root folder, unless the name is a path from the top or a URI itself; blank names are no paths: ValueError."""
        if not name.strip():
            raise ValueError("a path must be given")
        return name if name.startswith("/") or "://" in name else f"{self.root.rstrip('/')}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, self.path(name))

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name))


def processed_rows(raw: DataFrame, run_at: datetime) -> DataFrame:
    """Rows of posts_processed for raw posts: cleaned texts, tags as location, sentiments pending; dropped where the text is too short."""
    none = F.struct(F.lit("neutral").alias("label"), F.lit(0.0).alias("score"), F.lit("pending").alias("model"))
    created = F.col("created_at") if dict(raw.dtypes)["created_at"].startswith("timestamp") else F.lit(None)
    return raw.select(
        F.col("_id").cast("bigint").alias("post_id"), clean_text(F.col("text")).alias("text"), F.struct(none.alias("llm"), none.alias("transformer")).alias("sentiment"),
        F.struct(tag(F.col("post_tags"), 1).alias("province"), tag(F.col("post_tags"), 2).alias("district")).alias("location"),
        F.coalesce(created.cast("timestamp_ntz"), F.lit(run_at).cast("timestamp_ntz")).alias("created_at"), F.lit(True).alias("_anonymized"),
        F.lit("text_preprocessing").alias("_processing_step"),
    ).where("text IS NOT NULL")


def fetch(ctx: Context, data: Any) -> dict:
    """Requests to records of their pages; without a source of pages or anything asked for it does nothing."""
    if ctx.pages is None or data is None:
        return {"skipped": "no source of pages" if ctx.pages is None else "nothing asked for"}
    return fetching.fetch(ctx, data)


def preprocess(ctx: Context, _: Any = None) -> dict:
    raw = ctx.table("posts_raw")
    old = ctx.table("posts_processed") if ctx.has("posts_processed") else processed_rows(raw.limit(0), ctx.run_at)
    new = processed_rows(skip_known(raw, old, "_id", "post_id"), ctx.run_at)
    report = step_summary(raw.withColumn("_c", clean_text(F.col("text"))), old, "_c", "_id", "post_id").first().asDict()
    report["sample"] = [r.post_id for r in new.select("post_id").limit(SAMPLE).collect()]
    upsert(ctx.spark, new, ctx.path("posts_processed"), ["post_id"], ["created_at"])
    return report


def _classify(ctx: Context, data: Any, model: str) -> dict:
    """Predictions for the posts that wait for them; with an evaluation asked for, its figures instead."""
    wanted = data.get("evaluation") if isinstance(data, dict) else None
    if isinstance(wanted, dict) and wanted.get("enabled"):
        return evaluation(ctx, model, wanted)
    posts = ctx.table("posts_processed")
    todo = pending(posts, model)
    if n := todo.count():
        replace_table(with_prediction(posts, ctx.models[model].predictions(todo, "post_id"), model), ctx.path("posts_processed"), ["post_id"])
    return {"classified": n}


def evaluation(ctx: Context, model: str, options: dict) -> dict:
    """Figures and errors of a model on a labelled CSV file (``dataset_path``; ``text_column``, ``label_column``, ``id_column``,
    ``error_limit``). Without a usable sample all figures are 0."""
    k = int(options.get("error_limit") or ERRORS)
    x = samples(ctx.spark, ctx.path(options.get("dataset_path") or ""), options.get("text_column") or "text", options.get("label_column") or "label", options.get("id_column"))
    x = x.withColumn("ord", F.monotonically_increasing_id())
    m = ctx.models[model]
    judged = evaluated(x, m, "ord")
    figures = scores_of(judged).first().asDict()

    def rows(errors: DataFrame) -> list[dict]:
        got = errors.collect()  # k at most
        ids = {r.ord: r.entry_id for r in x.where(F.col("ord").isin([r.ord for r in got])).select("ord", "entry_id").collect()} if got else {}
        return [{"entry_id": ids[r.ord]} | {c: r[c] for c in ("expected", "predicted", "score", "text")} for r in got]

    return {
        "total_samples": judged.count(), "metrics": figures, "total_misclassified": figures["fp"] + figures["fn"],
        "misclassified_examples": rows(first_errors(judged, "ord", k)), "hardest_errors": rows(hardest_errors(judged, "ord", k)),
    }


def geospatial(ctx: Context, _: Any = None) -> dict:
    posts = ctx.table("posts_processed")
    places = ctx.table("places").where("kind <> 'category'").select(
        F.col("place_id").alias("ord"), F.when(F.col("kind") == "province", F.col("name")).otherwise(F.col("province")).alias("province"),
        F.when(F.col("kind") == "district", F.col("name")).otherwise("").alias("district"))
    todo = untagged(posts)
    found = tagged(todo, places)
    x = todo.drop("location").join(found.select(F.col("post_id"), F.struct("province", "district").alias("location")), "post_id").select(*posts.columns)
    report = found.agg(F.count("*").alias("scanned"), F.count_if(F.col("province") != "").alias("matched")).first().asDict()
    upsert(ctx.spark, x, ctx.path("posts_processed"), ["post_id"], ["created_at"])
    write_collection(ctx.table("posts_processed"), ctx.table("posts_raw"), ctx.path("map"), ctx.run_at.isoformat())
    return report


def aggregation(ctx: Context, _: Any = None) -> dict:
    x = province_sentiment(ctx.table("posts_processed"), datetime(1950, 1, 1), datetime(2026, 12, 31))
    x = x.withColumns({"district": F.lit("ALL"), "last_updated": F.lit(ctx.run_at).cast("timestamp_ntz")})
    upsert(ctx.spark, x, ctx.path("sentiment_aggregates"), ["province", "district", "model_type"], ["last_updated"])
    return {"groups": x.count()}


Step = Callable[[Context, Any], dict]
#: Name -> step. A step reads and writes tables of the context and returns a small report; it sees what the run was asked.
STEPS: dict[str, Step] = {
    "fetch": fetch, "preprocess": preprocess, "sentiment": lambda c, d: _classify(c, d, "transformer"), "sentiment_llm": lambda c, d: _classify(c, d, "llm"),
    "geospatial": geospatial, "sentiment_aggregation": aggregation,
}


def run(ctx: Context, selected: list[str] | None = None, steps: dict[str, Step] | None = None, data: Any = None) -> dict:
    """Run the steps, or those selected, in order; an error ends the run. The report is also a file in the folder reports."""
    known = steps or STEPS
    if unknown := [s for s in selected or [] if s not in known]:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    out = {name: step(ctx, data) for name, step in known.items() if not selected or name in selected}
    report = json.dumps({"run_at": ctx.run_at.isoformat(), **out}, ensure_ascii=False, default=str)
    write_file(ctx.spark, ctx.path(f"reports/{ctx.run_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}.json"), report)
    return out
