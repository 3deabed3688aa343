"""Sources mixed to target shares of tokens.

Tokens per document are counted once with a public tokenizer and summed per source. The mixture is as large as the caps
allow: its size is the least of cap * tokens / share over the sources. A source's rate is what it must give over what it
has; a document comes floor(rate) times and once more with the probability of the fraction, drawn from a hash of its key
and the seed, so the draw depends on nothing but the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yakamoz.runtime import cut

#: File of the default tokenizer; a parameter of every function here.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Sources with a target, at most.
MAX_SOURCES = 10_000


@lru_cache(2)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: list[str], column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens`` bigint; null and empty texts have 0."""
    x = df.select(*keep, F.col(column).alias("__text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "__text"]
    return x.mapInArrow(count, ", ".join([*fields, "n_tokens bigint"]))


def rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeat``, ``available_tokens``, ``rate``) of the sources that have a target and tokens.

    counts: (source, n_tokens). Shares of sources without tokens are spread over the others in proportion.
    """
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeat > 0").dropDuplicates(["source"]).select("source", "target_share", "max_repeat")
    listed = t.limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    has = counts.join(F.broadcast(t.select("source")), "source").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    tokens = {r.source: r.n for r in has.where("n > 0").collect()}
    own = sorted((r.source, float(r.target_share), int(r.max_repeat)) for r in listed if r.source in tokens)
    size = min((cap * tokens[s] / share for s, share, cap in own), default=0.0)
    rows = [(s, share, cap, tokens[s], min(size * share / tokens[s], float(cap))) for s, share, cap in own]
    return counts.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeat int, available_tokens bigint, rate double")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)).cast("double") / float(1 << 40)


def _copies(key: str, seed: int) -> Column:
    whole = F.floor(F.col("rate"))
    return (whole + F.when(draw(F.col(key), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", column: str = "text", seed: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ``source``, ``copy_no``, ``n_tokens``): the mixture, one row for each use of a document; copy_no starts at 1.

    Documents without a source or with one that has no target are left out; the keys are unique, else equal keys draw alike.
    Null and empty texts count 0 tokens and are drawn like others. Empty tables give an empty result; further columns,
    also such of the same names, are ignored.
    """
    own = cut(token_counts(docs, [key, "source"], column, tokenizer).where("source IS NOT NULL"))
    r = rates(own.select("source", "n_tokens"), targets).select("source", "rate")
    # one row for each target
    x = own.join(F.broadcast(r), "source").withColumn("_n", _copies(key, seed)).where("_n > 0")
    return x.select(key, "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), "n_tokens")


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", column: str = "text", seed: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeat``, ``available_tokens``, ``rate``, ``mixed_tokens``, ``mixed_documents``,
    ``actual_share``, ``most_copies``): what the mixture of the same arguments really reaches."""
    own = cut(token_counts(docs, [key, "source"], column, tokenizer).where("source IS NOT NULL"))
    r = rates(own.select("source", "n_tokens"), targets)  # one row for each target
    n = own.join(F.broadcast(r.select("source", "rate")), "source").withColumn("_n", _copies(key, seed))
    got = n.groupBy("source").agg(
        F.sum(F.col("_n") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("_n").alias("mixed_documents"), F.max("_n").alias("most_copies"))
    all_ = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # MAX_SOURCES rows at most
    share = F.col("mixed_tokens") / F.sum("mixed_tokens").over(all_)
    return r.join(got, "source").select(*r.columns, "mixed_tokens", "mixed_documents", share.alias("actual_share"), "most_copies")
