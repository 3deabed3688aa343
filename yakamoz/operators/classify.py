"""Batch classifiers as pluggable Arrow functions, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.functions.sentiment import classifier_label, generated_label
from yakamoz.operators.aggregate import confusion, metrics

#: A classifier is made once in each task and maps a batch of texts to (label, score) pairs.
Classifier = Callable[[list[str]], list[tuple[str, float]]]
BATCH, ERRORS, SHOWN = 16, 25, 240
# Words of the built-in lexicon classifier.
POSITIVE = "güzel harika iyi temiz mükemmel huzurlu keyif tavsiye memnun kusursuza içten doldurucu yeterli".split()
NEGATIVE = "kötü berbat rezalet zayıf bakımsız özensiz soğuk pahalı gürültülü dağınık kalabalık yorucu vasatın".split()


def lexicon() -> Classifier:
    """Counts good and bad words; stands in where no model is at hand."""

    def run(texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            words = t.lower().split()
            good, bad = sum(w in POSITIVE for w in words), sum(w in NEGATIVE for w in words)
            p = (good + 1) / (good + bad + 2)
            out.append(("POSITIVE", p) if p >= 0.5 else ("NEGATIVE", 1 - p))
        return out

    return run


@dataclass(frozen=True)
class Model:
    """A classifier as a plug-in: how to make it, what it is called, texts in a batch, characters that it can take (all, if None) and
    whether it answers in words, so that its label and score are those of the answer."""

    make: Callable[[], Classifier]
    name: str
    batch: int = BATCH
    max_chars: int | None = None
    generates: bool = False

    def predictions(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, ``label``, ``score``, ``model``): positive or negative for each row."""
        raw = classified(df, self.make, key, text, self.batch, self.max_chars)
        if self.generates:
            x = raw.withColumn("_r", generated_label(F.col("label"), F.col("score"))).select(key, "_r.label", "_r.score")
        else:
            x = raw.withColumn("label", classifier_label(F.col("label"), F.col("score")))
        return x.withColumn("model", F.lit(self.name))


def classified(df: DataFrame, make: Callable[[], Classifier], key: str, text: str = "text", batch: int = BATCH, max_chars: int | None = None) -> DataFrame:
    """(key, ``label``, ``score``): ``make`` runs once a task. The whole text goes to the model unless it has a bound of its own."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = df.select(F.col(key), (F.substring(t, 1, max_chars) if max_chars else t).alias("_t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [r for i in range(0, len(texts), batch) for r in model(texts[i : i + batch])]
            label, score = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], [key, "label", "score"])

    return x.mapInArrow(run, f"`{key}` {x.schema[key].dataType.simpleString()}, label string, score double")


def evaluated(samples: DataFrame, model: Model, key: str, text: str = "text", label: str = "label") -> DataFrame:
    """(key, ``text``, ``expected``, ``predicted``, ``score``, ``is_error``) of labelled samples; blank texts are left out. An expected
    label that is neither positive nor negative counts as negative."""
    s = samples.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(
        key, F.col(text).alias("text"), classifier_label(F.col(label), F.lit(0.0)).alias("expected"))
    p = model.predictions(s, key).select(F.col(key).alias("_k"), F.col("label").alias("predicted"), "score")
    x = s.join(p, F.col(key) == F.col("_k")).drop("_k")
    return x.withColumn("is_error", F.col("expected") != F.col("predicted"))


def scores_of(evaluation: DataFrame) -> DataFrame:
    return metrics(confusion(evaluation, "expected", "predicted"))


def hardest_errors(evaluation: DataFrame, key: str, k: int = ERRORS) -> DataFrame:
    """The k most confident errors."""
    x = evaluation.where("is_error").withColumn("text", F.substring("text", 1, SHOWN))
    return x.orderBy(F.col("score").desc(), key).limit(k)


def first_errors(evaluation: DataFrame, key: str, k: int = ERRORS) -> DataFrame:
    x = evaluation.where("is_error").withColumn("text", F.substring("text", 1, SHOWN))
    return x.orderBy(key).limit(k)
