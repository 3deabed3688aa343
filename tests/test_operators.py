import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from yakamoz import __main__ as cli
from yakamoz import runtime
from yakamoz.operators import aggregate as agg
from yakamoz.operators import classify as cls
from yakamoz.operators import html as page
from yakamoz.operators import location as loc
from yakamoz.operators import requests as req
from yakamoz.operators import tables as tab
from yakamoz.plans import geojson, pipeline, runs, sections
from yakamoz.sources import readers, web
from yakamoz.streaming.incremental import stream_posts, windowed_counts

MODEL = "struct<label: string, score: double, model: string>"
POSTS = f"post_id bigint, text string, sentiment struct<llm: {MODEL}, transformer: {MODEL}>, location struct<province: string, district: string>, created_at timestamp_ntz"
T = datetime(2024, 5, 1)


def post(i, text, province, llm, transformer, district=None, at=T):
    return (i, text, ((llm, 0.9, "m"), (transformer, 0.7, "m")), (province, district), at)


@pytest.fixture
def posts(spark):
    return spark.createDataFrame([
        post(1, "iyi ekonomi", "Adana", "positive", "negative"), post(2, "kötü ekonomi", "Adana", "negative", "negative"), post(3, "great city", "Ankara", "positive", "positive"),
        post(4, "yok", "", "positive", "positive"), post(5, "eski", "Ankara", "positive", "positive", at=datetime(1940, 1, 1)), post(6, "x", "Ankara", "neutral", "neutral", "Çankaya"),
    ], POSTS)


def test_province_sentiment(posts):
    got = {(r.province, r.model_type): (r.total_posts, r.average_sentiment, r.normalized_score, r.positive, r.negative)
           for r in agg.province_sentiment(posts, datetime(1950, 1, 1), datetime(2026, 12, 31)).collect()}
    assert got == {("Adana", "llm"): (2, 0.0, 0.5, 1, 1), ("Adana", "transformer"): (2, -1.0, 0.0, 0, 2), ("Ankara", "llm"): (1, 1.0, 1.0, 1, 0), ("Ankara", "transformer"): (1, 1.0, 1.0, 1, 0)}
    one = agg.province_sentiment(posts, datetime(1950, 1, 1), datetime(2026, 12, 31), "EKONOMI", "positive").collect()
    assert [(r.province, r.model_type, r.total_posts) for r in one] == [("Adana", "llm", 1)]


def test_map(posts, spark):
    rows = {(r.grain, r.province, r.district, r.model_type): (r.total_posts, r.positive, r.neutral, r.negative, r.sentiment_label) for r in agg.map_counts(posts).collect()}
    assert rows["province", "Ankara", None, "llm"] == (3, 2, 1, 0, "positive")
    assert rows["district", "Ankara", "Çankaya", "llm"] == (1, 0, 1, 0, "neutral") and rows["district", "Unknown", "Unknown", "llm"][0] == 1
    raw = spark.createDataFrame([(1, ["Ulaşım", "Adana"]), (2, None), (3, [" ulaşım "])], "_id bigint, post_tags array<string>")
    cats = {(r.province, r.model_type, r.category): (r.total, r.map_color_score) for r in agg.map_categories(posts, raw).collect()}
    assert cats["Adana", "llm", "ulaşım"] == (1, 1.0) and cats["Adana", "llm", "uncategorized"] == (1, 0.0)
    m = agg.map_metadata(posts).first()
    assert (m.unmatched_posts, m.total_provinces, m.total_districts) == (1, 3, 4)
    f = {(r.level, r.province, r.district): json.loads(r.feature) for r in geojson.features(posts, raw).collect()}
    one = f["province", "Adana", ""]
    assert one["geometry"] is None and "district" not in one["properties"] and one["properties"]["province_code"] == "TR-01"
    assert one["properties"]["models"]["llm"]["distribution"] == {"positive": 1, "neutral": 0, "negative": 1}
    assert f["district", "Ankara", "Çankaya"]["properties"]["district"] == "Çankaya"


SAMPLES = [(1, "Türkiye çok güzel", "positive"), (2, "Bu hizmet çok kötü", "negative"), (3, "Harika bir deneyim", "positive"), (4, "Berbat bir sistem", "negative"), (5, " ", "positive")]


def test_evaluation(spark):
    def stub():
        return lambda texts: [("NEGATIVE" if "kötü" in t.lower() or "berbat" in t.lower() else "POSITIVE", 0.9) for t in texts]

    model = cls.Model(stub, "stub")
    ev = cls.evaluated(spark.createDataFrame(SAMPLES, "item_id int, text string, label string"), model, "item_id")
    r = cls.scores_of(ev).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.macro_f1) == (2, 2, 0, 0, 1.0, 1.0) and cls.hardest_errors(ev, "item_id").count() == 0
    wrong = cls.evaluated(spark.createDataFrame([(i, "kötü", "positive") for i in range(30)], "item_id int, text string, label string"), model, "item_id")
    assert [r.item_id for r in cls.first_errors(wrong, "item_id", 3).collect()] == [0, 1, 2] and cls.hardest_errors(wrong, "item_id").count() == 25
    empty = cls.scores_of(ev.limit(0)).first()
    assert (empty.accuracy, empty.macro_f1) == (0.0, 0.0)


def test_batches_and_cut(spark):
    seen = lambda: lambda texts: [(str(len(texts)), float(max(map(len, texts)))) for _ in texts]
    df = spark.createDataFrame([(i, "x" * 600) for i in range(5)], "i int, text string").coalesce(1)
    assert sorted((r.label, r.score) for r in cls.classified(df, seen, "i", batch=2, max_chars=512).collect()) == [("1", 512.0)] + [("2", 512.0)] * 4
    assert {r.score for r in cls.classified(df, seen, "i").collect()} == {600.0}


def test_models_answer_in_labels_or_words(spark):
    df = spark.createDataFrame([(1, "x")], "i int, text string")
    one = lambda label, score, **k: tuple(cls.Model(lambda: lambda ts: [(label, score)] * len(ts), "m", **k).predictions(df, "i").first())[1:]
    assert one("LABEL_1", 0.8) == ("positive", 0.8, "m") and one("unknown", 0.3) == ("negative", 0.3, "m")
    assert one("<think>hm</think> Negative.", 0.7, generates=True) == ("negative", 0.9, "m") and one("?", 0.7, generates=True) == ("positive", 0.5, "m")


GAZ = [(1, "Adıyaman", ""), (2, "Adıyaman", "Merkez"), (3, "Ankara", ""), (4, "Adana", ""), (5, "İstanbul", ""), (6, "İstanbul", "Kadıköy"), (7, "Ankara", "Merkez")]


def test_location(spark):
    texts = [(1, "Üç günlük yeme içme turumu … Adana", []), (2, "", ["yemek", "kadıköy", "istanbul"]), (3, "çok iyi bir merkez ankara", None), (4, "ankaralı", None), (5, None, None),
             (6, "ADANA merkez", ["ankara"]), (7, "Istanbul", None)]
    got = loc.tagged(spark.createDataFrame(texts, "post_id int, text string, tags array<string>"), spark.createDataFrame(GAZ, "ord int, province string, district string"), tags="tags")
    assert {r.post_id: (r.province, r.district) for r in got.collect()} == {
        1: ("Adana", ""), 2: ("İstanbul", "Kadıköy"), 3: ("Adıyaman", "Merkez"), 4: ("", ""), 5: ("", ""), 6: ("Ankara", ""), 7: ("", "")}
    more = spark.createDataFrame([*GAZ, (8, "Ankara", "Yeni  Kale"), (9, "Adana", "Su-Başı"), (10, "İzmir", "123"), (11, None, None)], "ord int, province string, district string")
    long_ = spark.createDataFrame([(1, "bugün YENİ kale tarafında"), (2, "yeni, kale"), (3, "su-başı"), (4, "su başı"), (5, "yeni\nkale ankara"), (6, "123"), (7, "yeni"), (7, "yeni")], "post_id int, text string")
    got = sorted((r.post_id, r.district) for r in loc.tagged(long_, more).collect())
    assert got == [(1, "Yeni  Kale"), (2, ""), (3, "Su-Başı"), (4, ""), (5, "Yeni  Kale"), (6, ""), (7, ""), (7, "")]
    assert loc.tagged(long_, more.limit(0)).where("province <> ''").count() == 0 and loc.tagged(long_.limit(0), more).count() == 0
    plan = loc.tagged(long_, more)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan
    codes = spark.createDataFrame([("Adana",), ("Düzce",), ("Ardahan",), ("Nowhere",)], "p string").select(loc.province_code(F.col("p")).alias("c")).collect()
    assert [r.c for r in codes] == ["TR-01", "TR-81", "TR-75", "TR-??"]


def test_tables(spark, tmp_path):
    x = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "", 1), (4, "", 2), (5, None, 1), (6, None, 0)], "i int, fp string, n int")
    assert sorted(r.i for r in tab.first_by(x, ["fp"], ["n"], unless=F.col("fp") == "").collect()) == [2, 3, 4, 6]
    few = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("b", None), (None, 4)], "k string, n int")
    assert sorted(map(tuple, tab.first_by(few, ["k"], ["n"]).collect()), key=repr) == sorted([("a", 1), ("b", None), (None, 4)], key=repr)
    assert sorted(map(tuple, tab.first_by(few.withColumn("v", F.lit(1)), ["k"], ["n"]).collect()), key=repr) == sorted([("a", 1, 1), ("b", None, 1), (None, 4, 1)], key=repr)
    assert sorted(r.i for r in tab.top_by(x, ["fp"], [F.col("n")], 1).collect()) == [2, 3, 6]
    known = spark.createDataFrame([(2,), (2,)], "k int")
    assert sorted(r.i for r in tab.skip_known(x, known, "i", "k").collect()) == [1, 3, 4, 5, 6] and [r.i for r in tab.only_known(x, known, "i", "k").collect()] == [2]
    new = spark.createDataFrame([(9, "a", 1), (8, "a", 2), (7, None, 1)], "i int, fp string, n int")
    assert sorted((r.i, r.fp or "") for r in tab.merged(x, new, ["fp"], ["n"]).collect()) == [(3, ""), (4, ""), (7, ""), (8, "a")]
    assert tab.duplicates(x, ["i"]).count() == 0 and tab.duplicates(x, ["fp"]).count() == 3
    p = f"file://{tmp_path}/t"
    tab.upsert(spark, x.where("fp = 'a' AND i = 1"), p, ["i"], ["n"])
    tab.upsert(spark, spark.createDataFrame([(1, "b", 9), (2, "c", 1)], "i int, fp string, n int"), p, ["i"], ["n"])
    assert sorted((r.i, r.fp) for r in tab.read_table(spark, p).collect()) == [(1, "b"), (2, "c")]


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    p = f"file://{tmp_path}/t"
    rows = spark.range(1000).selectExpr("id", "id AS v", "'clash' AS _b")
    tab.upsert(spark, rows.drop("_b"), p, ["id"], ["v"], buckets=16)
    _, before = tab._version(spark, p)
    tab.upsert(spark, spark.createDataFrame([(7, -1), (None, -2)], "id bigint, v bigint"), p, ["id"], ["v"])
    number, after = tab._version(spark, p)
    changed = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert number == 2 and len(after["folders"]) == 16 and 1 <= len(changed) <= 2
    got = {r.id: r.v for r in tab.read_table(spark, p).collect()}
    assert len(got) == 1001 and got[7] == -1 and got[8] == 8 and got[None] == -2
    files = tab.read_table(spark, p, {int(b) for b in changed}).inputFiles()
    assert files and all(f"_b={b}" in "".join(files) for b in changed) and not any(f"_b={b}/" in f for f in files for b in set(after["folders"]) - changed)
    tab.upsert(spark, rows.drop("_b").limit(0), p, ["id"], ["v"])
    assert tab._version(spark, p)[0] == 2
    tab.replace_table(tab.read_table(spark, p).where("id < 10"), p, ["id"])
    assert tab.read_table(spark, p).count() == 10 and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("data-")]) <= 3
    with pytest.raises(FileExistsError):
        runtime.write_file(spark, f"{p}/versions/{3:012d}.json", "{}")
    plain = f"{tmp_path}/plain"
    rows.drop("_b").write.parquet(plain)
    tab.upsert(spark, spark.createDataFrame([(7, -1)], "id bigint, v bigint"), plain, ["id"], ["v"])
    assert tab.read_table(spark, plain).where("v = -1").count() == 1 and tab.read_table(spark, plain).count() == 1000
    empty = f"{tmp_path}/empty"
    tab.upsert(spark, rows.drop("_b").limit(0), empty, ["id"], ["v"])
    assert tab.read_table(spark, empty).count() == 0 and tab.read_table(spark, empty).columns == ["id", "v"]


@pytest.mark.parametrize(
    ("text", "value"),
    [("", {}), ('{"a": 1}', {"a": 1}), ("{'a': None}", {"a": None}), ("{requests: [{province: Adana, num_results: 3}, {province: 'all', ok: true}]}",
      {"requests": [{"province": "Adana", "num_results": 3}, {"province": "all", "ok": True}]}), ("{url: http://a.b/c}", {"url": "http://a.b/c"}), (7, 7)],
)
def test_parse_input(text, value):
    assert req.parse_input(text) == value


def test_requests():
    with pytest.raises(ValueError):
        req.parse_input("neither nor")
    with pytest.raises(ValueError):
        req.requests_of({"requests": 5})
    assert req.requests_of("{}") is None and req.requests_of("{a: 1}") == [{"a": 1}] and req.request_of_flags(a=None, b=0, c=False) == {"b": 0}
    assert req.request_of_flags(level="district") == {} and req.request_of_flags(level="district", province="x") == {"level": "district", "province": "x"}
    assert len(req.every_request()) == 1 and len(req.every_request(True)) == 2


def test_expand(spark):
    d = spark.createDataFrame([("Adana", "Ceyhan"), ("Adana", "Kozan"), ("İzmir", "Çeşme")], "province string, district string")
    c = spark.createDataFrame([("kafe",), ("park",)], "category string")
    ddl = "request_id string, level string, province string, district string, category string, num_results int, max_topics int"
    rows = [("a", None, "adana", "KOZAN", "kafe", None, None), ("b", "district", "all", None, "*", 2, 1), ("c", None, None, None, "serbest", None, None), ("d", None, "nowhere", None, "kafe", None, None)]
    got = req.keyed(req.expand(spark.createDataFrame(rows, ddl), d.select("province").distinct(), d, c), "s.example").collect()
    n = {k: sum(r.request_id == k for r in got) for k in "abcd"}
    assert n == {"a": 1, "b": 6, "c": 2, "d": 0}
    one = next(r for r in got if r.request_id == "a")
    assert (one.level, one.district, one.num_results, one.request_key, one.fetch_key) == ("district", "Kozan", 5, "district|||Adana|||Kozan|||kafe", "Adana | Kozan | kafe")
    tasks = spark.createDataFrame(got)
    assert req.guarded(tasks).count() == 9
    for bad in (tasks.limit(0), spark.range(101).toDF("x")):
        with pytest.raises(ValueError):
            req.guarded(bad)
    assert req.guarded(spark.range(101).toDF("x"), confirm_bulk=True).count() == 101
    asked = spark.createDataFrame(rows, ddl)
    assert [tuple(r) for r in req.unknown_names(asked, d.select("province").distinct(), d).collect()] == [("d", "province", "nowhere")]
    with pytest.raises(ValueError, match="nowhere"):
        req.known_names(asked, d.select("province").distinct(), d)
    other = spark.createDataFrame([("e", None, "İzmir", "Kozan", None, None, None), ("f", None, "all", "cesme", None, None, None), ("g", "province", None, "yok", None, None, None)], ddl)
    assert [tuple(r) for r in req.unknown_names(other, d.select("province").distinct(), d).collect()] == [("e", "district", "Kozan")]
    topics = spark.createDataFrame([("r", i, f"u{i}") for i in range(5)], "request_key string, rank int, topic_url string")
    none = spark.createDataFrame([], "topic_url string")
    own = topics.withColumn("max_topics", F.lit(3)).unionByName(topics.selectExpr("'s' AS request_key", "rank", "concat(topic_url, 's') AS topic_url", "CAST(NULL AS INT) AS max_topics"))
    n = {k: req.open_topics(own, none, k).groupBy("request_key").count().collect() for k in (2, None)}
    assert {r.request_key: r["count"] for r in n[2]} == {"r": 3, "s": 2} and {r.request_key: r["count"] for r in n[None]} == {"r": 3, "s": 5}
    assert [r.topic_url for r in req.open_topics(topics, spark.createDataFrame([("u0",)], "topic_url string"), 2).orderBy("rank").collect()] == ["u1", "u2"]


HTML = """<html><head><title>T</title></head><body><h1>Baş <b>lık</b></h1><ul id="entry-item-list"><li data-id="1" data-author="a"><div class="content">bir<br>iki &amp; üç</div>
<span class="entry-date">1.1.2020</span></li><li data-id="1"><div class="content">yine</div></li><li data-id="2"><div class="content"> </div></li><li><p class="content">kimliksiz</p></li></ul>
<a href="/x">git</a><a>yok</a></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([("u", HTML), ("v", None), ("w", "<li data-id=9><div class=content>tek"), ("z", "<div>" * 5000)], "url string, html string")
    got = sorted((r.url, r.ord, r.entry_id, r.author, r.date, r.content) for r in page.page_entries(df).collect())
    assert got == [("u", 0, "1", "a", "1.1.2020", "bir iki & üç"), ("u", 1, "", "", "", "kimliksiz"), ("w", 0, "9", "", "", "tek")]
    assert {r.url: r.title for r in page.page_titles(df).collect()} == {"u": "Baş lık", "v": "", "w": "", "z": ""}
    assert [(r.href, r.link_text) for r in page.page_links(df).collect()] == [("/x", "git")]
    paged = spark.createDataFrame([("t", 1, "<p>x"), ("t", 2, HTML), ("t", 3, "<title>später</title>"), ("v", 1, "")], "topic_url string, page int, html string")
    assert {r.topic_url: r.title for r in page.topic_titles(paged).collect()} == {"t": "Baş lık", "v": ""}
    topics = spark.createDataFrame([("t",)], "topic_url string")
    plan = page.page_plan(topics, spark.createDataFrame([("t?p=2",)], "page_url string"))
    assert sorted(r.page for r in plan.collect()) == [1, 3, 4, 5]


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    assert [r.p for r in readers.lines(spark, put("p.csv", "﻿province\nAdana\n\n Ankara \n"), "p", "province").collect()] == ["Adana", "Ankara"]
    assert sorted(r.category for r in readers.categories(spark, put("c.csv", "category,word\nkafe,a\nkafe,b\npark,c\n")).collect()) == ["kafe", "park"]
    assert sorted(r.category for r in readers.categories(spark, put("d.csv", "category\nkafe\nkafe\n")).collect()) == ["kafe"]
    rows = readers.districts(spark, put("e.csv", "province,district\nAdana,Ceyhan\nAdana,CEYHAN\nAdana,nan\n,x\n")).collect()
    assert [tuple(r) for r in rows] == [("Adana", "Ceyhan")]
    order = readers.districts(spark, put("o.csv", "province,district\nİzmir,Çeşme\nAdana,KOZAN\nAdana,Ceyhan\nAdana,Kozan\n")).collect()
    assert [tuple(r) for r in order] == [("Adana", "Ceyhan"), ("Adana", "KOZAN"), ("İzmir", "Çeşme")]
    assert [r.category for r in readers.categories(spark, put("q.csv", "category\npark\nkafe\npark\nat\n")).collect()] == ["park", "kafe", "at"]
    with pytest.raises(ValueError):
        readers.districts(spark, put("f.csv", "a,b\n1,2\n"))
    assert readers.state(spark, str(tmp_path / "none.csv"), "k").count() == 0 and readers.state(spark, put("g.csv", "k\n1\n1\n"), "k").count() == 1
    assert [(r.text, r.entry_id) for r in readers.samples(spark, put("h.csv", "text,label\n iyi ,positive\n ,negative\n")).collect()] == [("iyi", "")]
    schema = "a int"
    from pyspark.sql.types import _parse_datatype_string

    s = _parse_datatype_string(schema)
    assert [r.a for r in readers.json_list(spark, put("i.json", '[{"a": 1}, {"a": 2}]'), s).collect()] == [1, 2] and readers.json_list(spark, "/nowhere.json", s).count() == 0
    (tmp_path / "t" / "x").mkdir(parents=True)
    (tmp_path / "t" / "x" / "k_clean.json").write_text('[{"a": 5}]')
    (tmp_path / "t" / "k_raw.json").write_text('[{"a": 6}]')
    assert [r.a for r in readers.json_tree(spark, str(tmp_path / "t"), "_clean.json", s).collect()] == [5]
    for k in "xy":
        readers.append_event(spark, f"file://{tmp_path}/log", kind=k, at=T)
    assert [r.kind for r in spark.read.json(f"{tmp_path}/log").orderBy("kind").collect()] == ["x", "y"]
    for new in (["b", "a", None], ["b", "c"]):
        readers.add_state(spark, spark.createDataFrame([(x,) for x in new], "k string"), f"file://{tmp_path}/keys", "k")
    assert sorted(r.k for r in spark.read.option("header", True).csv(f"{tmp_path}/keys").collect()) == ["a", "b", "c"]


def test_pipeline(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/posts_raw.parquet")
    raw.write.parquet(str(tmp_path / "posts_raw"))
    spark.read.parquet("/root/testdata/sf0.001/places.parquet").write.parquet(str(tmp_path / "places"))
    ctx = pipeline.Context(spark, f"file://{tmp_path}", run_at=T)
    out = pipeline.run(ctx)
    assert list(out) == ["fetch", "preprocess", "sentiment", "sentiment_llm", "geospatial", "sentiment_aggregation"] and out["preprocess"]["processed"] > 0
    done = ctx.table("posts_processed").cache()
    assert done.where("sentiment.llm.model = 'pending'").count() == 0 and tab.duplicates(done, ["post_id"]).count() == 0
    assert {r[0] for r in done.select("sentiment.transformer.label").distinct().collect()} <= {"positive", "negative"}
    n = done.count()
    again = pipeline.run(ctx, ["preprocess"])["preprocess"]
    assert again["processed"] == 0 and again["skipped_existing"] == out["preprocess"]["processed"] and again["sample"] == []
    kept = ctx.table("posts_processed")
    assert kept.count() == n and kept.where("sentiment.llm.model = 'pending'").count() == 0  # predictions outlive a second run
    assert ctx.table("sentiment_aggregates").count() == out["sentiment_aggregation"]["groups"] > 0
    first = spark.read.text(str(tmp_path / "map")).where("value LIKE '%FeatureCollection%'").first().value
    assert json.loads(first)["metadata"]["total_provinces"] > 1
    with pytest.raises(ValueError):
        pipeline.run(ctx, ["nothing"])
    (tmp_path / "e.csv").write_text("text,label\nTürkiye çok güzel,positive\nBu hizmet çok kötü,negative\nberbat,positive\n ,positive\n", encoding="utf-8")
    ask = {"evaluation": {"enabled": True, "dataset_path": "e.csv", "error_limit": 5}}
    got = pipeline.run(ctx, ["sentiment"], data=ask)["sentiment"]
    assert (got["total_samples"], got["total_misclassified"], got["metrics"]["tp"], got["metrics"]["tn"]) == (3, 1, 1, 1) and got["hardest_errors"][0]["text"] == "berbat"
    with pytest.raises(ValueError):
        pipeline.run(ctx, ["sentiment"], data={"evaluation": {"enabled": True}})


class Forum:
    """Two topics for each query; the second page of the first one is missing."""

    def search(self, queries):
        links = F.array(F.lit("https://s.example/a?x=1"), F.lit("https://s.example/a/"), F.concat(F.lit("https://s.example/b-"), F.hash("query")), F.lit(" "))
        return queries.select("query", F.posexplode(links).alias("rank", "link"))

    def pages(self, urls):
        body = F.concat(F.lit("<h1>Konu</h1><ul id=entry-item-list>"), *[
            F.concat(F.lit(f"<li data-id={k}><div class=content>"), F.lit(text), F.lit("</div><span class=date>01.02.2020 10:00</span></li>"))
            for k, text in ((1, "Bu uzun bir metindir, tamam"), (2, "bu uzun bir METİNDİR, tamam".replace("İ", "i")), (3, "kısa"))])
        return urls.where("url LIKE '%p=1'").select("url", body.alias("html"))


def test_fetch(spark, tmp_path):
    spark.createDataFrame([(1, "province", None, "Adana"), (2, "district", "Adana", "Kozan"), (3, "category", None, "kafe")], "place_id int, kind string, province string, name string").write.parquet(str(tmp_path / "places"))
    ctx = pipeline.Context(spark, f"file://{tmp_path}", run_at=T, pages=Forum())
    ask = {"requests": [{"province": "adana", "district": "KOZAN", "category": "all"}, {"province": "Adana", "category": "kafe", "max_topics": 1}]}
    got = pipeline.run(ctx, ["fetch"], data=ask)["fetch"]
    assert (got["tasks"], got["topics"], got["pages"]) == (2, 3, 2)
    assert (got["new_raw_posts"], got["new_clean_posts"], got["new_invalid_posts"], got["duplicates_skipped"]) == (6, 3, 3, 0)
    raw = ctx.table("posts_raw")
    assert raw.count() == 2 and {r.created_at for r in raw.collect()} == {"2020-02-01 10:00:00"}  # topic a is one for both tasks
    assert sorted(ctx.spark.read.parquet(ctx.path("sections/invalid")).select("issues").distinct().collect()[0].issues) == ["text_too_short"]
    section = spark.read.parquet(ctx.path("sections/clean"))
    assert [sections.merged(section, s).count() for s in ("all", "province", "district")] == [2, 2, 3]
    again = pipeline.run(ctx, ["fetch"], data=ask)["fetch"]
    assert (again["tasks"], again["new_raw_posts"]) == (0, 0)
    for bad in ({"province": "nowhere"}, {"province": "Adana", "district": "yok"}, {}):
        with pytest.raises(ValueError):
            pipeline.run(ctx, ["fetch"], data=bad)
    assert pipeline.run(pipeline.Context(spark, f"file://{tmp_path}", run_at=T), ["fetch"], data=ask)["fetch"] == {"skipped": "no source of pages"}


def test_web(spark):
    assert web.keys_of(" a,b\n a ", "c") == ["a", "b"] and web.keys_of(None, "c d") == ["c", "d"] and web.keys_of("", None) == []
    pauses = []

    def answers(*given):
        it = iter(given)

        def get(_):
            x = next(it)
            if x is None:
                raise OSError
            return x, f"<p>{x}</p>"

        return get

    read = lambda *a: web.page(answers(*a), "u", sleep=pauses.append)
    assert read(404) is None and read(503, None, 200) == "<p>200</p>" and pauses == [5.0, 10.0] and read(429, 500, 403) is None
    with pytest.raises(RuntimeError):
        read(400)
    ask = lambda q, n, k: (401, []) if k == "old" else (200, ["https://s.example/a", "https://x.example/b", "https://s.example/a", "https://s.example/c"])
    assert web.links(ask, "q", 5, ["old", "new"], "s.example") == ["https://s.example/a", "https://s.example/c"]
    for bad, keys in ((ask, ["old"]), (ask, []), (lambda *_: (500, []), ["k"])):
        with pytest.raises(RuntimeError):
            web.links(bad, "q", 5, keys, "s.example")
    w = web.Web(lambda u: (404, "") if "b" in u else (200, u), ask, ["new"], "s.example", delay=0.0)
    assert [tuple(r) for r in w.search(spark.createDataFrame([("q", None)], "query string, num_results int")).collect()] == [("q", 0, "https://s.example/a"), ("q", 1, "https://s.example/c")]
    assert {r.url: r.html for r in w.pages(spark.createDataFrame([("a",), ("b",)], "url string")).collect()} == {"a": "a", "b": None}


def test_sections(spark):
    ddl = "post_id string, is_valid boolean, level string, province string, district string, category string, collected_at int"
    rows = [("a", True, "district", "Adana", "Kozan", "kafe", 1), ("a", True, "province", "Adana", None, "kafe", 2), ("b", False, "province", "Adana", None, "kafe", 3), ("c", True, "province", "Adana", "", "kafe", 4), (None, True, "province", "x", None, "k", 5)]
    df = spark.createDataFrame(rows, ddl)
    known = sections.bucketed(df).where("post_id = 'c' OR collected_at = 2")
    got = {k: sorted(r.collected_at for r in v.collect()) for k, v in sections.split(sections.bucketed(df), {"raw": known, "clean": None}).items()}
    assert got == {"raw": [1, 3], "clean": [1], "invalid": [3], "duplicates": [2, 4]}
    assert [r.district_slug for r in sections.bucketed(df).orderBy("collected_at").collect()] == ["kozan", "all", "all", "all", "all"]


def test_runs_and_command_line(spark, tmp_path, monkeypatch, capsys):
    go = threading.Event()
    monkeypatch.setattr(runs, "STEPS", {"wait": lambda c, d: {"waited": go.wait(60), "got": d}, "fail": lambda c, d: 1 / 0})
    r = runs.Runner(pipeline.Context(spark, f"file://{tmp_path}", run_at=T))
    assert r.status() == {"status": "idle"} and not r.stop() and r.logs("x") == []
    one = r.start("wait", {"a": 1})
    with pytest.raises(runs.Busy):
        r.start("wait")
    assert r.status()["status"] == "running"
    go.set()
    r.wait(60)
    assert one["status"] == "completed" and one["report"]["wait"]["got"] == {"a": 1} and len(r.logs(one["id"])) == 2
    r.start("fail")
    r.wait(60)
    assert [x["status"] for x in r.runs()] == ["error", "completed"] and len(list((tmp_path / "runs").glob("*.json"))) == 2
    with pytest.raises(ValueError):
        r.start("nothing")
    assert cli.asked(cli.parser().parse_args(["--root", "x", "--level", "district"])) is None
    assert cli.asked(cli.parser().parse_args(["--root", "x", "--province", "Adana", "--max-topics", "2"])) == {"province": "Adana", "max_topics": 2}
    assert cli.asked(cli.parser().parse_args(["--root", "x", "--input", "{province: Adana}"])) == {"province": "Adana"}
    answers = iter(["9", "x", "2"])
    assert cli.choose(lambda _: next(answers)) == "fetch" and cli.choose(lambda _: "1") is None
    assert cli.main(["--root", f"file://{tmp_path}", "--step", "fetch"], spark) == 0 and "no source of pages" in capsys.readouterr().out


def test_cut_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda k, d=None: d)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context, "conf": Conf})

    with pytest.raises(RuntimeError):
        runtime.cut(Frame)


def test_stream(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/posts_raw.parquet").withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    src, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    raw.where("_id <= 150").write.parquet(src)
    stream_posts(spark, src, raw.schema, target, cp, T).awaitTermination()
    n = tab.read_table(spark, target).count()
    raw.where("_id > 140").write.mode("append").parquet(src)
    stream_posts(spark, src, raw.schema, target, cp, T).awaitTermination()
    got = tab.read_table(spark, target)
    assert got.count() > n and tab.duplicates(got, ["post_id"]).count() == 0
    assert got.count() == pipeline.processed_rows(raw, T).count()
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 1, 5), "a"), (datetime(2024, 1, 1, 1, 50), "a"), (datetime(2024, 1, 1, 2, 0), "a")], "ts timestamp, k string")
    assert sorted(r.n for r in windowed_counts(ev, "ts", "k").collect()) == [1, 2]
