import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from yakamoz.functions import records as rec
from yakamoz.functions import sentiment as sen
from yakamoz.functions import text as txt


def column(spark, values, f):
    """Results of a column function for text values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string").coalesce(1)
    return [r.r for r in df.select("i", f(F.col("c")).alias("r")).orderBy("i").collect()]


WORD = re.compile(r"[^\W]")


def cleaned(t):
    """The cleaning steps, written plainly."""
    if t is None:
        return None

    def word(c):
        return c == "_" or unicodedata.category(c)[0] in "LN"

    w = "[" + "".join(re.escape(c) for c in {c for c in t if word(c)} | {"_"}) + "]"
    b = rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    t = re.sub(txt.EMAIL, "[EMAIL]", t)
    t = re.sub(rf"{b}(?:\+90|0)?\s?(?:5\d{{2}})\s?\d{{3}}\s?\d{{2}}\s?\d{{2}}{b}", "[PHONE]", t)
    t = re.sub(rf"{b}\d{{11}}{b}", "[ID]", t)
    w = w[:-1] + "A-Z]"
    b = rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    t = re.sub(rf"{b}(?:[uU]ser(?:name)?\s*[:=]?\s*{w}+|[uU]ser\s+{w}+){b}", "[USERNAME]", t)
    t = re.sub(r"https?://\S+|www\.\S+", "", t)
    t = re.sub(rf"@{w}+", "", t)
    t = t.replace("İ", "i").replace("I", "ı").lower()
    t = "".join(c if word(c) or c.isspace() else " " for c in t)
    t = " ".join(re.sub(r"(.)\1{2,}", r"\1", t).split())
    t = " ".join(x for x in t.split(" ") if x not in txt.STOPWORDS)
    return t if len(t.strip()) >= 3 else None


GOLDEN = [
    ("mail ali@x.com ok", "mail emaıl ok"), ("call +90 532 123 45 67", "call 90 phone"), ("no 12345678901 ok", "no ıd ok"), ("users", "username"), ("coool", "col"), ("İI", None),
    ("ab", None), (None, None), ("", None), ("çok güzel BİR Işık", "güzel bir ışık"), ("bak https://a.b/c?d #etiket @kisi!", "bak etiket"), ("a 1️⃣ bin", "a bin"),
]


def test_clean_text(spark):
    assert column(spark, [a for a, _ in GOLDEN], txt.clean_text) == [b for _, b in GOLDEN]


def test_clean_text_against_plain_python(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/posts_raw.parquet").select("text").collect()]
    assert column(spark, rows, txt.clean_text) == [cleaned(t) for t in rows]


def test_keys(spark):
    assert column(spark, [" Kadıköy  Çarşı ", "ŞİŞLİ"], txt.lookup_key) == ["kadikoy carsi", "şi̇şli̇".replace("ş", "s")]
    assert column(spark, ["Lale Bahçesi!", "???", None], txt.slug) == ["lale_bahcesi", "unlisted", "unlisted"]
    assert column(spark, ["https://a.b/c/?p=3#x", "https://a.b/c//"], txt.topic_url) == ["https://a.b/c", "https://a.b/c"]
    assert column(spark, ["https://a.b/c?p=3", "https://a.b/c?p=0", "https://a.b/c", "x?q=1&p=12&r"], txt.start_page) == [3, 1, 1, 12]
    assert column(spark, ["Hepsi", "*", "ALL", "kafe"], txt.is_all) == [True, True, True, False]
    assert column(spark, ["x", None], lambda c: txt.composite_key(c, F.lit("y"))) == ["x|||y", "|||y"]
    assert column(spark, ["Kadıköy", None], lambda c: txt.search_query("s.example", F.lit("İzmir"), c, F.lit("Kafe")))[0].endswith("kadikoy kafe")


def test_dates(spark):
    values = ["01.02.2020 10:00", "1.2.2020", "01.02.2020 10:00 ~ 11:00", "", "1.2.2020 10:00 tarihinde", "2020-02-01T10:00:00.5+03:00", "2020-02-31", None]
    got = column(spark, values, lambda c: F.date_format(rec.parse_date(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2020-02-01 10:00:00", "2020-02-01 00:00:00", None, None, "2020-02-01 10:00:00", "2020-02-01 07:00:00", None, None]


def test_fingerprints(spark):
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert column(spark, [" Çok  iyi\n", "", None], rec.fingerprint) == [sha("çok iyi"), "", ""]
    key = column(spark, [" metin "], lambda c: rec.post_key(F.lit("s"), F.lit(None), F.lit("7"), F.lit(2), c))
    assert key == [sha("s||7|2|metin")]


def test_tags_and_issues(spark):
    df = spark.createDataFrame([(1, ["a", " b ", None]), (2, []), (3, None)], "i int, t array<string>").orderBy("i")
    assert [r[0] for r in df.select(rec.tag(F.col("t"), 1)).collect()] == ["b", "", ""]
    got = spark.range(1).select(rec.build_tags(F.lit(" k "), F.lit(""), F.lit(None).cast("string"), F.lit("d")).alias("x")).first().x
    assert got == ["k", "d"]
    x = spark.createDataFrame([("kısa", "s", None, "district", None), ("yeterince uzun bir metin", "s", "tr", "province", None)], "t string, s string, l string, lv string, d string")
    found = rec.issues(F.col("t"), F.col("s"), F.col("l"), F.lit(1), F.lit(True), F.lit("k"), F.lit("p"), F.col("d"), F.col("lv"))
    got = x.select(found.alias("f"), rec.is_valid(found).alias("v")).collect()
    assert [(r.f, r.v) for r in got] == [(["text_too_short", "missing_language", "fallback_timestamp_used", "missing_district"], False), (["fallback_timestamp_used"], True)]


@pytest.mark.parametrize(
    ("p", "u", "n", "score", "label"),
    [(100, 0, 0, 1.0, "positive"), (0, 0, 100, 0.0, "negative"), (50, 0, 50, 0.5, "neutral"), (0, 100, 0, 0.5, "neutral"), (0, 0, 0, 0.5, "neutral"), (3, 1, 1, 0.7, "positive")],
)
def test_color_score(spark, p, u, n, score, label):
    r = spark.range(1).select(sen.color_score(F.lit(p), F.lit(n), F.lit(p + u + n)).alias("s"))
    r = r.select("s", sen.score_label(F.col("s")).alias("l")).first()
    assert (r.s, r.l) == (pytest.approx(score), label)


def test_labels(spark):
    cases = [("positive", 0.9, "positive"), ("negative", 0.9, "negative"), ("LABEL_0", 0.8, "negative"), ("LABEL_1", 0.8, "positive"), ("unknown", 0.7, "positive"), ("unknown", 0.3, "negative")]
    df = spark.createDataFrame(cases, "a string, s double, e string")
    assert all(r.g == r.e for r in df.select("e", sen.classifier_label(F.col("a"), F.col("s")).alias("g")).collect())
    cases = [("positive", 0.1, "positive", 0.9), ("<think>reasoning</think>negative", 0.9, "negative", 0.9), ("it is positive", 0.1, "positive", 0.75), ("unknown", 0.7, "positive", 0.5),
             ("unknown", 0.3, "negative", 0.5), (None, 0.7, "positive", 0.5)]
    df = spark.createDataFrame(cases, "a string, s double, e string, w double")
    got = df.select("e", "w", sen.generated_label(F.col("a"), F.col("s")).alias("g")).collect()
    assert all((r.g.label, r.g.score) == (r.e, r.w) for r in got)
