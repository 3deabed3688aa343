"""From requests to records: tasks, topics, pages, entries, validated records, sections, posts_raw.

Search and page download are the source's (``sources.readers.PageSource``); all between is declared on tables. What was done is
kept in state tables, so a run that starts again goes on where the last one ended. A request is done when its pages came.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.functions import records as rec
from yakamoz.functions.text import composite_key, topic_url
from yakamoz.operators import html, requests
from yakamoz.operators.tables import first_by, skip_known, upsert
from yakamoz.plans import sections
from yakamoz.runtime import cut
from yakamoz.sources.readers import add_state, state

if TYPE_CHECKING:
    from yakamoz.plans.pipeline import Context


def dimensions(ctx: Context) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(provinces, districts, categories) of the table places."""
    p = ctx.table("places")
    pick = lambda kind: p.where(F.col("kind") == kind)
    return (pick("province").select(F.col("name").alias("province")), pick("district").select("province", F.col("name").alias("district")),
            pick("category").select(F.col("name").alias("category")))


def topics_of(tasks: DataFrame, found: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Topics of the tasks' search results (``query``, ``rank``, ``link``): canonical, each task's first ones that weren't done for it."""
    x = tasks.join(found.where(F.coalesce(F.trim("link"), F.lit("")) != ""), "query").withColumn("topic_url", topic_url(F.col("link")))
    x = x.withColumn("topic_key", composite_key(F.col("topic_url"), F.col("level"), F.col("province"), F.col("district"), F.col("category")))
    x = first_by(x, ["topic_key"], ["rank", "request_id"])
    x = skip_known(x, done, "topic_key")
    return requests.open_topics(x.drop("query", "link"), done.select(F.col("topic_key").alias("topic_url")).limit(0), most)


def records_of(topics: DataFrame, pages: DataFrame, source: str, language: str, collected_at) -> DataFrame:  # noqa: ANN001
    """Validated records of the topics' pages (``topic_url``, ``page``, ``html``): an entry counts once within a topic and task if its
    text has a fingerprint."""
    x = pages.withColumn("_k", F.concat_ws("\1", "topic_url", F.col("page").cast("string")))
    e = html.page_entries(x.select("_k", "html"), "_k").withColumns({"topic_url": F.split("_k", "\1")[0], "page": F.split("_k", "\1")[1].cast("int")}).drop("_k")
    x = topics.join(e, "topic_url").join(html.topic_titles(pages).withColumnRenamed("title", "topic_title"), "topic_url", "left")
    at = F.lit(collected_at).cast("timestamp_ntz")
    parsed = rec.parse_date(F.col("date"))
    text = F.trim("content")
    x = x.withColumns({
        "text": text, "source": F.lit(source), "language": F.lit(language), "collected_at": at, "created_at": F.coalesce(parsed.cast("timestamp_ntz"), at),
        "timestamp_used_fallback": parsed.isNull(), "raw_created_at": F.col("date"), "text_fingerprint": rec.fingerprint(text),
        "post_id": rec.post_key(F.lit(source), F.col("topic_url"), F.col("entry_id"), F.col("page"), text),
        "post_tags": rec.build_tags(F.col("category"), F.col("province"), F.col("district")),
    })
    found = rec.issues(F.col("text"), F.col("source"), F.col("language"), F.col("created_at"), F.col("timestamp_used_fallback"), F.col("category"), F.col("province"),
                       F.col("district"), F.col("level"))
    x = x.withColumn("issues", found).withColumn("is_valid", rec.is_valid(F.col("issues")))
    return first_by(x, ["topic_key", "text_fingerprint"], ["page", "ord"], unless=F.col("text_fingerprint") == "")


def posts(records: DataFrame) -> DataFrame:
    """Records as rows of posts_raw; ``_id`` is a number made of ``post_id``."""
    place = F.struct("province", F.col("district").alias("district"))
    return records.select(
        F.xxhash64("post_id").alias("_id"), "post_id", "text", F.col("created_at").cast("string").alias("created_at"), "collected_at", "source", "language", "post_tags",
        place.alias("location"), "category", "topic_url", "page", "author", "level")


def fetch(ctx: Context, data: Any) -> dict:
    """Run what was asked for and return its counters."""
    spark = ctx.spark
    asked = requests.requests_of(data)
    if asked is None:
        raise ValueError("no tasks")
    dims = dimensions(ctx)
    rows = requests.known_names(requests.request_rows(spark, asked), dims[0], dims[1])
    tasks = requests.guarded(requests.keyed(requests.expand(rows, *dims), ctx.site), confirm_bulk=any(bool(r.get("confirm_bulk")) for r in [*asked, data if isinstance(data, dict) else {}]))
    seen = lambda name, column: state(spark, ctx.path(f"state/{name}"), column)
    left = cut(skip_known(tasks, seen("completed_requests", "request_key"), "request_key"))
    found = ctx.pages.search(left.select("query", "num_results").distinct())
    most = data.get("max_topics") if isinstance(data, dict) else None
    topics = cut(topics_of(left, found, seen("completed_topics", "topic_key"), most))
    plan = html.page_plan(topics.select("topic_url").distinct(), seen("visited_pages", "page_url"))
    pages = ctx.pages.pages(plan.select(F.col("page_url").alias("url")))
    pages = cut(plan.join(pages, F.col("page_url") == F.col("url")).drop("url").where("html IS NOT NULL"))
    records = cut(records_of(topics, pages, ctx.site, "tr", ctx.run_at))
    counts = sections.export(spark, records, ctx.path("sections"))
    good = records.where("is_valid")
    upsert(spark, posts(good), ctx.path("posts_raw"), ["post_id"], ["collected_at", "created_at"])
    came = pages.select("topic_url").distinct()
    add_state(spark, pages, ctx.path("state/visited_pages"), "page_url")
    add_state(spark, topics.join(came, "topic_url", "left_semi"), ctx.path("state/completed_topics"), "topic_key")
    # done: no topic of the request is left without a page
    missing = topics.join(came, "topic_url", "left_anti").select("request_key").distinct()
    add_state(spark, skip_known(left.join(topics.select("request_key").distinct(), "request_key", "left_semi"), missing, "request_key"), ctx.path("state/completed_requests"), "request_key")
    return {"tasks": left.count(), "topics": topics.count(), "pages": pages.count(), **counts}
