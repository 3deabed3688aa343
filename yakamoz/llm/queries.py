"""Queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakamoz.llm.abuse import rates, scored
from yakamoz.llm.canonical import mapped
from yakamoz.llm.copies import collapsed, copies
from yakamoz.llm.leaks import leaked
from yakamoz.llm.lookalikes import forms, look_alike_classes, look_alike_pairs
from yakamoz.llm.mixture import mix, shares
from yakamoz.llm.personal import personal_items, personal_kinds
from yakamoz.llm.quality import layouts, not_prose, statistics
from yakamoz.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {
    "p9_statistics": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\r\n]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \t\r]', '', 'g') <> '') AS l, length(regexp_replace(t, '[ \t\r\n]', '', 'g')) AS v FROM t)
      SELECT doc_id, length(t)::BIGINT AS n_chars, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines, coalesce(v::DOUBLE / nullif(len(w), 0), 0) AS mean_word_length,
        coalesce(length(regexp_replace(t, '[\p{L}\p{N} \t\r\n]', '', 'g'))::DOUBLE / nullif(v, 0), 0) AS symbol_ratio,
        coalesce(length(regexp_replace(t, '[^0-9]', '', 'g'))::DOUBLE / nullif(v, 0), 0) AS digit_ratio,
        coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][ \t\r]*$')))::DOUBLE / nullif(len(l), 0), 0) AS lines_ending_in_punctuation,
        coalesce(len(list_distinct(list_transform(w, lambda x: lower(replace(x, 'İ', 'i̇')))))::DOUBLE / nullif(len(w), 0), 0) AS distinct_words FROM w""",
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spread(table(spark, d, "posts_processed")), table(spark, d, "post_labels"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("abusive").select("post_id")


@query
def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(_scores(spark, d), table(spark, d, "posts_raw"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "posts_raw"), table(spark, d, "posts_processed"), table(spark, d, "places"))


@query
def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Number of values of each table and position that name no entry, and of those that do."""
    return p3_found(spark, d).groupBy("src", "pos").agg(
        F.count_if(F.col("place_id") == 0).alias("n_unmatched"), F.count_if(F.col("place_id") != 0).alias("n_mapped"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_kinds(spread(table(spark, d, "posts_raw")), table(spark, d, "given_names"))


@query
def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal_items(spread(table(spark, d, "posts_raw")), table(spark, d, "given_names")).drop("kinds")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    posts = look_alike_pairs(spread(table(spark, d, "posts_raw")), "_id", "text", tbl="posts_raw")
    return posts.union(look_alike_pairs(table(spark, d, "districts"), "district_id", "district", "province", tbl="districts"))


@query
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms(spread(table(spark, d, "posts_raw")), "_id", "text")


@query
def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    posts = look_alike_classes(spread(table(spark, d, "posts_raw")), "_id", "text", tbl="posts_raw")
    return posts.union(look_alike_classes(table(spark, d, "districts"), "district_id", "district", "province", tbl="districts"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(spread(table(spark, d, "posts_raw")))


@query
def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spread(table(spark, d, "posts_raw")), short=True)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(spread(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that give them away."""
    got = leaked(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))
    return got.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("score").alias("best_score"))


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(spread(table(spark, d, "documents")), table(spark, d, "source_targets"))


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(spread(table(spark, d, "documents")), table(spark, d, "source_targets"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(spread(table(spark, d, "documents")))


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return statistics(spread(table(spark, d, "documents").select("doc_id", "text")))


@query
def p9_layouts(spark: SparkSession, d: str) -> DataFrame:
    return layouts(spread(table(spark, d, "documents")))
