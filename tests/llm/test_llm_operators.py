"""Fixtures for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from yakamoz.llm import abuse, canonical, copies, leaks, lookalikes, mixture, personal, quality
from yakamoz.llm.queries import QUERIES
from yakamoz.runtime import table

SF = "/root/testdata/sf0.001"

LONG = "kelime " * 40_000


def frame(spark, rows, ddl):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(rows, ddl).withColumns({c: F.lit("clash") for c in ("n", "root", "record", "form", "kind", "k", "v", "_t", "score")})


FOUND = {
    "p2_found": "post_id bigint", "p3_found": "src string, rec_id bigint, pos int, place_id int", "p4_found": "raw_id bigint, kind string", "p5_found": "tbl string, key_a bigint, key_b bigint",
    "p6_found": "first_id bigint, copy_id bigint", "p7_found": "doc_id bigint, item_id int", "p9_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    """Every query has rows; those of the found cases have their columns and no row twice."""
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows or name == "p2_found"  # five labels teach little
    if name in FOUND:
        assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == FOUND[name] and len(set(rows)) == len(rows) and all(None not in r for r in rows)


# look-alikes


def test_classes_are_transitive():
    uf = lookalikes.UnionFind()
    for a, b in (("a", "b"), ("b", "c"), ("x", "y")):
        uf.union(a, b)
    assert sorted(map(tuple, uf.classes())) == [("a", "b", "c"), ("x", "y")]
    own = next(c for c in lookalikes.classes() if "a" in c)
    assert {"a", "а", "ａ", "ɑ"} <= set(own)


def test_representative_is_the_most_frequent():
    to = lookalikes.representatives({"а": 5, "a": 3})
    assert to["a"] == "а" and lookalikes.representatives({"a": 5, "а": 3})["а"] == "a"


@pytest.mark.parametrize(
    ("a", "b"),
    [("kаfe", "kafe"), ("ｋａｆｅ", "kafe"), ("ka​fe", "kafe"), ("üst", "üst"), ("a b", "a b"), ("i̇l", "il"), ("а̂", "â"), ("ﬁn", "fin"), ("a　b", "a b"),
     ("s‍̧", "ş")],
)
def test_consistent_form(a, b):
    f = lookalikes.Rewriter(lookalikes.representatives({}))
    assert f(a) == f(b) == b


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("ağ", "ag"), ("Ev", "ev"), ("ı", "i"), ("a b", "a  b")])
def test_different_looks_stay(a, b):
    f = lookalikes.Rewriter(lookalikes.representatives({}))
    assert f(a) != f(b)


def test_look_alike_pairs(spark):
    rows = [(1, "kafe", "x"), (2, "kаfe", "x"), (3, "kafe", "x"), (4, "kafe", "y"), (5, None, "x"), (6, "", "x"), (7, " ", "x"), (8, " ", "x"), (9, LONG, "x"),
            (10, LONG.replace("e", "е"), "x"), (11, "ka fe", "x"), (12, "ka\tfe", "x"), (13, "kаfe", None)]
    df = frame(spark, rows, "id bigint, text string, scope string")
    got = {(r.key_a, r.key_b) for r in lookalikes.look_alike_pairs(df, "id", "text", "scope", "t").collect()}
    assert got == {(1, 2), (2, 3), (9, 10)}
    f = lookalikes.Rewriter(lookalikes.representatives({}))
    brute = {
        (a[0], b[0]) for a, b in itertools.combinations(rows, 2)
        if a[1] and b[1] and a[1] != b[1] and f(a[1]) == f(b[1]) and f(a[1]).strip()
    }
    assert {(r.key_a, r.key_b) for r in lookalikes.look_alike_pairs(df, "id", "text").collect()} == brute
    assert lookalikes.look_alike_pairs(df.limit(0), "id", "text").count() == 0


def test_forms_and_classes(spark):
    rows = [(1, "kafe", "x"), (2, "kаfe", "x"), (3, "kafe", "y"), (4, None, "x"), (5, " ", "x"), (6, "park", "x"), (6, "park", "x")]
    df = frame(spark, rows, "id bigint, text string, scope string")
    assert {(r.key, r.form) for r in lookalikes.forms(df, "id", "text").collect()} == {(1, "kafe"), (2, "kafe"), (3, "kafe"), (4, None), (5, " "), (6, "park")}
    got = sorted(tuple(r) for r in lookalikes.look_alike_classes(df, "id", "text", tbl="t").collect())
    assert got == [("t", 1, 1, 3, 2), ("t", 2, 1, 3, 2), ("t", 3, 1, 3, 2), ("t", 6, 6, 2, 1), ("t", 6, 6, 2, 1)]
    apart = sorted((r.key, r.class_id, r.n_rows) for r in lookalikes.look_alike_classes(df, "id", "text", "scope").collect())
    assert apart[:3] == [(1, 1, 2), (2, 1, 2), (3, 3, 1)] and lookalikes.look_alike_classes(df.limit(0), "id", "text").count() == 0


def test_rewriting_goes_to_the_fixed_point():
    chain = {chr(0x4E00 + i): chr(0x4E01 + i) for i in range(40)}
    assert lookalikes.Rewriter(chain)(chr(0x4E00)) == chr(0x4E00 + 40)
    turns = lookalikes.Rewriter({"x": "y", "y": "x"})
    assert turns("x") == turns("y") == "x"


def test_hot_form_costs_only_its_pairs(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") == 77, "kаfe").otherwise("kafe").alias("text"))
    assert lookalikes.look_alike_pairs(df, "id", "text").count() == 19_999


# copies


def test_copies(spark):
    rows = [
        (1, "Bugün hava çok güzel!"), (2, "bugün  hava\nÇOK güzel"), (3, "BUGÜN HAVA ÇOK GÜZEL..."), (4, "bugun hava cok guzel"), (5, "puan: 5 | mekan: Uzun Park; giriş: 12"),
        (6, "GİRİŞ = 12\nPUAN = 5\nMEKAN = UZUN PARK"), (7, "puan: 12 | mekan: Uzun Park; giriş: 5"), (8, "kısa"), (9, "KISA"), (10, None), (11, ""), (12, LONG), (13, LONG.upper()),
        (14, "hava çok güzel bugün"), (15, "Bugün hava çok güzel 👍"), (16, "Bugün hаva çok güzel"),
    ]
    df = frame(spark, rows, "_id bigint, text string")
    got = {(r.first_id, r.copy_id) for r in copies.copies(df).collect()}
    assert got == {(1, 2), (1, 3), (1, 16), (5, 6), (12, 13)}
    n = {r.first_id: r.n_copies for r in copies.collapsed(df).collect()}
    assert n[1] == 4 and n[5] == 2 and n[7] == 1 and 8 not in n
    assert copies.copies(df.limit(0)).count() == 0
    twice = {(r.first_id, r.copy_id) for r in copies.copies(df.unionByName(df)).collect()}
    assert twice == got


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Bir iki üç dört beş adı: Uzun Park | puan: 5", "PUAN = 5\nbir iki üç dört beş adı = uzun park", True), ("x" * 90 + ": bir; y: iki", "y: iki; " + "x" * 90 + ": bir", True),
     ("yer: {il: Ankara; ilçe: Çankaya} | puan: 5", "puan: 5 | yer: {ilçe=Çankaya; il=Ankara}", True), ("yer: {il: a; alt: [x: 1; y: 2]} | p: 5", "p: 5 | yer: (alt: {y: 2; x: 1}; il: a)", True),
     ("yer: {il: Ankara; ilçe: Çankaya} | puan: 5", "yer: {il: Çankaya; ilçe: Ankara} | puan: 5", False), ("yer: {il: a} | puan: 5", "yer: il a | puan: 5", False),
     ("durum: kötü :( | yer: park", "yer: park | durum: kötü :(", True), ("açılış: 10:30 | kapanış: 22:00", "kapanış: 22:00; açılış: 10:30", True),
     ("saat 10:30 da geldi\nsaat 11:45 te gitti", "saat 11:45 te gitti\nsaat 10:30 da geldi", False), ("bak https://a.example/x\nsonra https://b.example/y", "sonra https://b.example/y\nbak https://a.example/x", False)],
)
def test_trees(a, b, same):
    assert (copies.tree(a) == copies.tree(b)) is same


def test_deep_nesting():
    text = "a: 1"
    for _ in range(300):
        text = f"a: {{{text}}}; b: 2"
    assert copies.tree(text)[0] != copies.tree(text.replace("1", "3"))[0]
    for long_ in ("a" + " " * 200_000 + "b\nc: d", "!" * 200_000, "a: " * 100_000 + "b\nc: d", "(" * 100_000 + "a: b; c: d", "a:\n" * 50_000):
        assert copies.tree(long_)


def test_collapsed_keeps_every_row(spark):
    rows = [(1, "+1"), (2, "+1"), (3, None), (4, " "), (5, "yok ya"), (6, "Otobüs yine geç kaldı!"), (7, "otobüs yine geç kaldı"), (8, "")]
    for d, n in ((SF, table(spark, SF, "posts_raw").count()), (None, 8)):
        got = QUERIES["p6_collapsed"](spark, d) if d else copies.collapsed(frame(spark, rows, "_id bigint, text string"), short=True)
        assert got.agg(F.sum("n_copies")).first()[0] == n
    assert sorted((r.first_id, r.n_copies) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (8, 1)]


def test_hot_copies(spark):
    df = spark.range(30_000).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, "Hep aynı uzun metin!").otherwise(F.concat(F.lit("metin sayısı "), F.col("id"))).alias("text"))
    assert copies.copies(df).count() == 9_999


# canonical lists

PLACES = [
    (1, "category", None, "kahve mekanları"), (2, "category", None, "gezi noktaları"), (3, "province", None, "Dırdümlı"), (4, "province", None, "Mölmökkent"),
    (5, "district", "Dırdümlı", "Tıksurlı"), (6, "district", "Dırdümlı", "Ortaköy"), (7, "district", "Mölmökkent", "Ortaköy"), (8, "district", "Mölmökkent", "Yeklerhisar"),
]


@pytest.mark.parametrize(
    ("pos", "value", "province", "expected"),
    [(0, "KAHVE MEKANLARI", "", 1), (0, "#kahve_mekanlari", "", 1), (0, "gezi onkaları", "", 2), (0, "kahve mekanlarÄ±", "", 1), (0, "qwerty", "", 0), (1, "il: Dirdumli", "", 3),
     (1, "Mlmkkent", "", 4), (1, "DÄ±rdÃ¼mlÄ±", "", 3), (1, "Wuxelberg", "", 0), (2, "ortakoy", "Dırdümlı", 6), (2, "Ortaköy'de", "molmokkent", 7), (2, "ortakoy", "", 0),
     (2, "tiskurli", "nowhere", 5), (2, "Yeklerhisar/Mölmökkent", "Mölmökkent", 8), (2, "yeklerhisar", "Dırdümlı", 0), (0, "📍", "", 0), (0, LONG, "", 0)],
)
def test_resolve(pos, value, province, expected):
    assert canonical.Places(PLACES).resolve(pos, value, province) == expected


def test_mapped(spark):
    raw = frame(spark, [(1, ["kahve mekanlari", "Dırdümlı", "tiksurli"]), (2, None), (3, []), (4, [None, " ", "x"]), (5, ["gezi noktaları", "molmokkent"]), (5, ["gezi noktaları", "molmokkent"])],
                "_id bigint, post_tags array<string>")
    done = frame(spark, [(1, ("DIRDÜMLI", "Tıksurlı")), (2, ("", "")), (3, None)], "post_id bigint, location struct<province: string, district: string>")
    places = spark.createDataFrame(PLACES, "place_id int, kind string, province string, name string")
    got = sorted((r.src, r.rec_id, r.pos, r.place_id) for r in canonical.mapped(raw, done, places).collect())
    assert got == [("posts_processed", 1, 1, 3), ("posts_raw", 1, 0, 1), ("posts_raw", 1, 2, 5), ("posts_raw", 4, 2, 0), ("posts_raw", 5, 1, 4), ("posts_raw", 5, 1, 4)]
    assert canonical.mapped(raw.limit(0), done.limit(0), places).count() == 0
    assert all(r.place_id == 0 for r in canonical.mapped(raw, done, places.limit(0)).collect())


# personal information


def finder():
    return personal.Finder(frozenset({"oya", "kerim", "umut"}), frozenset({"bortulu", "pekcalar"}), frozenset({"hava", "guzel", "esnaf"}))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("yaz: ali.veli+x@posta.example!", ["email"]), ("ali [at] posta [nokta] example", ["email"]), ("o_can et kutum nokta example yaz", ["email"]), ("iki kişi @ 436 lira, 2019 fiyatı", []),
     ("@okur84 ne dersin", []), ("https://a.example/b/21540?p=5", []), ("tel: 0(579)8060992", ["phone"]), ("cep o563-915-5566", ["phone"]), ("ara +1 (212) 555-0199", ["phone"]),
     ("(0499) 314 58 37", ["phone"]), ("sıfır beş yedi dokuz iki beş dört sekiz üç dokuz üç", ["phone"]), ("fatura no 2413770475 için", []), ("kargo takip no 15596530524 yolda", []),
     ("sipariş kodu 59407249-13", []), ("TC: 785 343 440 47 dedim", ["id"]), ("pasaportum U 42516301 kayıtta", ["id"]), ("kimlik: 97474342929. 117. Sk. 140/A D:5", ["address", "id"]),
     ("evim Lale Bahçesi Caddesi No 66 Kat 5 Daire 28", ["address"]), ("Kavaklık Caddesi boyunca yürüdük", []), ("24 numaralı hat 7. sokaktan dönüyor", []), ("tersane sokağı 9 dakika", []),
     ("teşekkürler Oya Börtülü", ["name"]), ("imza: Ö. PEKÇALAR", ["name"]), ("Börtülü, Kerim geldi", ["name"]), ("Oya ile konuştum", []), ("Umut Usta yine döktürmüş", []),
     ("Kerim Börtülü Parkı çok yeşil", []), ("", [])],
)
def test_items(text, kinds):
    assert sorted({k for _, _, k in finder().items(text)}) == kinds


@pytest.mark.parametrize("size", [20, 118, 125, 200, 3000])
def test_items_of_any_length_are_found(size):
    long_ = "a" * size
    assert [k for _, _, k in finder().items(f"yaz: {long_}@posta.example bekliyorum")] == ["email"]
    assert [k for _, _, k in finder().items(f"yaz: ali@{long_}.example bekliyorum")] == ["email"]
    assert [k for _, _, k in finder().items(f"evim {long_} sokak no 12")] == ["address"]
    assert [k for _, _, k in finder().items("evim Lale" + " " * size + "sokak" + " " * size + "no 12")] == ["address"]
    spelled = "yaz: ali [at] " + " [nokta] ".join(["posta"] * (size // 20 + 1)) + " [nokta] example"
    assert finder().items(spelled) == [(5, len(spelled), "email")]
    t = f"evim {long_.title()} Bahçesi Sokak No 12 arkada"
    assert personal.masked(t, finder().items(t)) == "evim [ADDRESS] arkada"


@pytest.mark.parametrize("text", ["kimliğim yedi iki üç dört altı bir sekiz dokuz iki üç yedi", "kimliğim yedi, beş, üç, dört, beş, bir, sekiz, dokuz, iki, üç, beş"])
def test_spelled_numbers_without_zero(text):
    assert [k for _, _, k in finder().items(text)] == ["id"]


def test_hot_copies_hide_no_names(spark):
    names = spark.createDataFrame([("Oya",), ("Kerim",)], "name string")
    hot = [(i, "size çok teşekkürler Oya Şengüdük") for i in range(300)]
    other = [(1000 + i, f"eski metin sayısı {i}") for i in range(600)] + [(2000, "ben Oya Tülbent geldim"), (2001, "ben Kerim Tülbent gittim"), (2002, "imza: Ş. Tülbent")]
    rows = hot + other + [(3000 + i, "eski tülbent dükkanı kapandı") for i in range(300)]
    got = {r.raw_id for r in personal.personal_kinds(frame(spark, rows, "_id bigint, text string"), names).collect()}
    assert got == {*range(300), 2000, 2001, 2002}
    common = personal.Finder(frozenset({"oya"}), frozenset(), frozenset({"senguduk"}))
    assert [k for _, _, k in common.items("size çok teşekkürler Oya Şengüdük")] == ["name"] and common.items("oya şengüdük gibi") == []


def test_masked_keeps_the_rest():
    t = "teşekkürler Oya Börtülü, tel: 0566.234.28.84 müsaitim"
    assert personal.masked(t, finder().items(t)) == "teşekkürler [NAME], tel: [PHONE] müsaitim"


def test_personal_items(spark):
    rows = [(1, "ben Oya Şengüdük geldim"), (2, "ben Kerim Şengüdük gittim"), (3, None), (4, ""), (5, LONG + "a@b.example"), (6, "imza: Ş. Şengüdük"), (6, "imza: Ş. Şengüdük")]
    names = spark.createDataFrame([("Oya",), ("Kerim",), (None,)], "name string")
    df = frame(spark, rows, "_id bigint, text string")
    got = sorted((r.raw_id, r.kind) for r in personal.personal_kinds(df, names).collect())
    assert got == [(1, "name"), (2, "name"), (5, "email"), (6, "name"), (6, "name")]
    text = {r.raw_id: r.masked for r in personal.personal_items(df, names).collect()}
    assert text[3] is None and text[4] == "" and text[1] == "ben [NAME] geldim"
    assert personal.personal_items(df.limit(0), names.limit(0)).count() == 0


# leaks


def brute_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


@pytest.mark.parametrize("seed", range(20))
def test_score_is_smith_waterman(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(0, 40))
    assert leaks.score(a, b) == brute_score(a, b)


@pytest.mark.parametrize(("size", "stretch", "changed"), [(36, 18, (9,)), (40, 20, (6, 13)), (50, 50, range(3, 50, 4)), (40, 17, None)])
def test_changed_words_count_as_covered(size, stretch, changed):
    item = [f"kelime{i}" for i in range(size)]
    text = ["başka" if i in (changed or ()) else w for i, w in enumerate(item[:stretch])]
    got = leaks.Index([(1, " ".join(item))]).leaks([" ".join(["önce"] * 30 + text + ["sonra"] * 30)])
    assert [i for _, i, _ in got] == ([1] if changed is not None else [])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 13, 14, 17, 20, 31, 48, 67])
def test_half_of_an_item_is_found(size):
    """Short items too, at every place, also where the corpus is full of their n-grams."""
    item = [f"kelime{i}" for i in range(size)]
    index = leaks.Index([(1, " ".join(item)), (2, "başka bir metin daha var burada")])
    rng = np.random.default_rng(size)
    index.rank({n: rng.integers(0, 9, len(g[0])) for n, g in index.grams.items()})
    half = -(-size // 2)
    for at in range(size - half + 1):
        assert [i for _, i, _ in index.leaks([" ".join(["önce"] * 9 + item[at : at + half] + ["sonra"] * 9)])] == [1]
    assert index.leaks([" ".join(["önce"] * 9)]) == [] and (size < 5 or index.leaks([" ".join(["önce"] * 9 + item[: half - 2])]) == [])


@pytest.mark.parametrize("size", [24, 31, 40, 50, 67])
@pytest.mark.parametrize("every", [4, 5, 7])
def test_changed_words_leave_a_seed(size, every):
    """Each fourth word changed or less often, all n-grams but the rarest common in the corpus."""
    item = [f"kelime{i}" for i in range(size)]
    index = leaks.Index([(1, " ".join(item))])
    for seed in range(5):
        rng = np.random.default_rng(seed)
        index.rank({n: rng.permutation(len(g[0])) for n, g in index.grams.items()})
        for first in range(every):
            text = [w if (i + first) % every else "başka" for i, w in enumerate(item)]
            assert [i for _, i, _ in index.leaks([" ".join(["önce"] * 20 + text + ["sonra"] * 20)])] == [1]


def test_texts_together_are_as_texts_alone(monkeypatch):
    rng = np.random.default_rng(4)
    vocab = [f"k{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(1, 30)))) for i in range(40)]
    texts = [None, "", *(" ".join(rng.choice(vocab, rng.integers(0, 90))) for _ in range(60)), *(f"a b {t} c" for _, t in items[:9])]
    index = leaks.Index(items)
    index.rank({n: rng.integers(0, 9, len(g[0])) for n, g in index.grams.items()})
    alone = [(d, i, s) for d, t in enumerate(texts) for _, i, s in index.leaks([t])]
    assert index.leaks(texts) == alone and len(alone) > 9
    monkeypatch.setattr(leaks, "AT_ONCE", 7)
    assert index.leaks(texts) == alone and index.leaks([]) == []


def test_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 9, rng.integers(1, 30)), rng.integers(0, 12, rng.integers(0, 40))
        assert leaks.bound(a, b) >= leaks.score(a, b)


def test_leaked(spark):
    rng = np.random.default_rng(3)
    vocab = [f"kelime{i}" for i in range(3000)]
    item = lambda: list(rng.choice(vocab, 40))
    one, two = item(), item()
    edited = [w if i % 11 else "başka" for i, w in enumerate(one)]
    filler = lambda: list(rng.choice(vocab, 60))
    docs = {
        1: filler() + one + filler(), 2: filler() + [w.upper() for w in edited] + filler(), 3: filler() + one[:24], 4: filler() + one[:12] + filler() + one[30:],
        5: filler(), 6: one + two, 7: filler() * 200 + two,
    }
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(8, None), (9, ""), (1, " ".join(docs[1]))]
    items = spark.createDataFrame([(1, " ".join(one)), (2, ", ".join(two)), (3, None), (4, "iki kelime"), (5, "")], "item_id int, text string")
    df = frame(spark, rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked(df, items).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (6, 1), (6, 2), (7, 2)]
    assert leaks.leaked(df.limit(0), items).count() == 0 and leaks.leaked(df, items.limit(0)).count() == 0


# mixture


def test_mixture(spark):
    rows = [(i, "a" if i % 10 else "b", f"metin sayısı {i} " * (1 + i % 5)) for i in range(3000)] + [(9001, None, "x"), (9002, "c", "y"), (9003, "a", None), (9004, "b", "")]
    df = frame(spark, rows, "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit("clash")).withColumn("rate", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4), ("none", 0.2, 3)], "source string, target_share double, max_repeat int")
    used = mixture.mix(df, t).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("copy_no").alias("m")).collect()
    assert {r.source for r in used} == {"a", "b"} and all(r.n == r.m for r in used)
    assert max(r.n for r in used if r.source == "a") == 1 and max(r.n for r in used if r.source == "b") <= 4
    report = {r.source: r for r in mixture.shares(df, t).collect()}
    assert report["a"].actual_share == pytest.approx(0.5, abs=0.05) and report["b"].rate == pytest.approx(4.0)
    assert sorted(map(tuple, mixture.mix(df, t).collect())) == sorted(map(tuple, mixture.mix(df.repartition(7), t).collect()))
    assert mixture.mix(df.limit(0), t).count() == 0 and mixture.mix(df, t.limit(0)).count() == 0 and mixture.shares(df, t.limit(0)).count() == 0


def test_token_counts_are_the_tokenizer_s(spark):
    texts = ["merhaba dünya", "", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = mixture._encoding(mixture.TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in mixture.token_counts(df, ["doc_id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts)


# quality

PROSE = "Bugün hava çok güzeldi. Sahil yolunda uzun uzun yürüdük, sonra çay bahçesinde oturduk. Akşam olunca eve döndük!"


@pytest.mark.parametrize(
    ("text", "kind"),
    [(PROSE, None), (PROSE.lower().replace(".", "").replace(",", ""), None), (PROSE.replace(", ", ",\n"), None), ("\n".join(PROSE.replace("!", ".").split(". ")), None),
     (PROSE + "\n- çay\n- kahve\n" + PROSE, None), ("\n".join(f"- çay bahçesi {i}" for i in range(8)), "list"), ("\n".join(f"Sahil yolu......{i}2" for i in range(8)), "list"),
     ("durak\tsaat\tpuan\n" + "\n".join(f"sahil yolu\t1{i}:00\t{i}" for i in range(6)), "table"), ("| durak | saat | puan |\n| --- | --- | --- |\n" + "| sahil yolu | 10:00 | 4 |\n" * 5, "table"),
     ("\n".join(f"  {1000 + i}    {2000 + i}    {3000 + i}" for i in range(6)), "table"), ("la " * 60, "junk"), ("!?" * 80, "junk"), ("<p>1</p><b>2</b>" * 20, "junk"),
     ("q7Zk/9x+PdYw" * 20, "junk"), ('{"k1":true,"k2":null,"k3":17}' * 8, "junk")],
)
def test_layout(text, kind):
    common = frozenset(quality._WORD.findall((PROSE + " çay kahve bahçesi durak saat puan sahil yolu").lower()))
    assert quality.layout(text, common)[-1] == kind


def test_long_entries_without_marks():
    entries = ["Sahil yolu durağı yanındaki eski taş fırın sabah açık", "Kale altı meydanı köşesindeki küçük çay bahçesi akşam açık", "Yeni çarşı girişindeki büyük kitap evi her gün açık",
               "Otogar karşısındaki geniş park yeri hafta sonu tamamen ücretsiz", "Liman caddesi sonundaki balık pazarı yalnız sabah erken kurulur", "Üniversite kapısı önündeki ucuz lokanta öğlen saatlerinde dolu"]
    common = frozenset(quality._WORD.findall(" ".join(entries).lower()))
    assert quality.layout("\n".join(entries), common)[-1] == "list"
    assert quality.layout("\n".join(e + "." for e in entries), common)[-1] is None
    text = " ".join(entries).lower().split()
    assert quality.layout("\n".join(" ".join(text[i : i + 8]) for i in range(0, len(text), 8)), common)[-1] is None


GAPPED = """durak              saat    ücret
köprü altı        22:26       59
kültür merkezi    09:21
iskele çevresi                68
hastane durağı    11:18       42"""
MARKED = "\n".join(f"- {w} kenarındaki eski taş fırının önünden geçen dar yol boyunca uzanan geniş yeşil çay bahçesi" for w in ("sahil", "kale", "çarşı", "liman", "otogar", "kampüs"))
TURNS = "\n".join(
    x for w, k in (("Sahil", "açık"), ("Kale", "kapalı"), ("Çarşı", "dolu"), ("Liman", "boş"), ("Otogar", "ucuz"), ("Kampüs", "pahalı"))
    for x in (f"{w} yolu durağı yanındaki eski taş fırın ve küçük çay bahçesi", k))


@pytest.mark.parametrize(
    ("signal", "without", "text", "kind"),
    [("columns", (0.0, 0, [False] * 5), GAPPED, "table"), ("periodicity", 0.0, MARKED, "list"), ("rhythm", 0.0, TURNS, "list")],
)
def test_each_signal_decides(monkeypatch, signal, without, text, kind):
    common = frozenset(quality._WORD.findall(f"{PROSE} {GAPPED} {MARKED} {TURNS}".lower()))
    assert quality.layout(text, common)[-1] == kind
    monkeypatch.setattr(quality, signal, lambda *_: without)
    assert quality.layout(text, common)[-1] != kind


def test_autocorrelation_decides(monkeypatch):
    common = frozenset(quality._WORD.findall(TURNS.lower()))
    monkeypatch.setattr(quality, "autocorrelation", lambda *_: 0.0)
    assert quality.layout(TURNS, common)[-1] is None


def test_signals():
    assert quality.periodicity(["- ", "  ", "- ", "  ", "- ", "  "]) == 1.0 and quality.periodicity([""] * 9) == 0.0 and quality.periodicity([]) == 0.0
    assert quality.rhythm(np.array([50.0, 8] * 6)) > 0.9 and quality.rhythm(np.full(4, 9.0)) == 1.0 and quality.rhythm(np.array([50.0] * 6 + [8.0] * 6)) < 0.3
    share, k, rows = quality.columns(GAPPED.split("\n"))
    assert (k, sum(rows)) == (3, 3) and share == 0.6 and quality.columns(["a b c", "d"])[2] == [False, False]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Tänään kävelimme rannalla pitkään ja joimme kahvia pienessä kahvilassa. Illalla palasimme kotiin väsyneinä, mutta iloisina.", None),
     ("Wczoraj poszliśmy na spacer brzegiem morza, a potem wypiliśmy herbatę w ogrodzie. Wieczorem wróciliśmy do domu.", None),
     ("Сегодня мы долго гуляли по набережной, потом пили чай в саду. Вечером вернулись домой уставшие, но довольные.", None),
     ("आज हम समुद्र के किनारे बहुत देर तक घूमते रहे और फिर बगीचे में बैठकर चाय पी। शाम को हम घर लौट आए।", None),
     ("今天我们在海边走了很久，然后在花园里喝茶。晚上我们回到家里，虽然很累，但是非常高兴。明天如果天气好，我们还想再去一次，顺便看看老城区的市场和那家新开的书店。", None),
     ("วันนี้เราเดินเล่นริมทะเลเป็นเวลานาน แล้วก็นั่งดื่มชาในสวน ตอนเย็นเรากลับบ้านด้วยความเหนื่อยแต่มีความสุขมาก", None),
     ("\n".join(f"- teetä ja kahvia {i}" for i in range(8)), "list"), ("jvekz azfğqkğeq avrfğzğzouğ rawjqrwqq hgıhvğsref xzhqşş qsccgkq kgcdgcgh fjwhğf xhlkq fwkgc kraktrk", "junk"),
     ("karud  minezuK  ıltat_888,ıtkıçacnuros  kınığad_,şumrud neçeg  aril_idlegarnos usurğodanaB ennatçaM_iğilzimet", "junk")],
)
def test_layout_without_common_words(text, kind):
    assert quality.layout(text, frozenset())[-1] == kind


def test_common_words_count_copies_once(spark):
    rare = "Сегодня мы долго гуляли {} по набережной и пили чай."
    texts = [f"Bugün hava çok güzeldi ve {a}{b} yürüdük." for a in "abcdefghij" for b in "klmnopqrst"] * 8 + ["jvekz azfğqkğeq avrfğz"] * 100 + [rare.format(w) for w in ("вчера", "утром", "днём")]
    common = quality.common_words(frame(spark, list(enumerate(texts)), "doc_id bigint, text string"), share=0.05)
    assert {"hava", "çok", "набережной"} <= common and not {"jvekz", "вчера"} & common


def test_quality_tables(spark):
    rows = [(1, PROSE), (2, None), (3, ""), (4, " \n "), (5, LONG), (1, PROSE), (6, "la " * 60)]
    df = frame(spark, rows, "doc_id bigint, text string")
    got = sorted(r.doc_id for r in quality.not_prose(df).collect())
    assert 6 in got and not {1, 2, 3, 4} & set(got)
    s = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert s[1].n_words == len(PROSE.split()) and s[2].n_words == 0 and s[5].n_words == 40_000 and s[1].lines_ending_in_punctuation == 1.0
    assert quality.statistics(df).count() == 7 and quality.layouts(df.limit(0)).count() == 0


# abuse


def test_features_see_disguise():
    def at(t, name):
        return abuse.features(t, abuse.words(t), {})[abuse.NAMES.index(name)]

    for t in ("aptal", "AAAPTAL", "4pt4l", "a p t a l", "ser efsiz", "srfsz", "şerefsiz", "şеrеfsiz"):
        assert at(t, "insults_density") > 0, t
    assert at("masanın üstünde etler vardı", "animals_density") == 0 and at("yarın hava güzel", "insults_density") == 0
    assert at("sen aptal", "insults_near_you") == 1 and at("aptal bir iki üç dört beş sen", "insults_near_you") == 0
    assert abuse.features(None, abuse.words(None), {}) == abuse.features("", abuse.words(""), {}) == [0.0] * len(abuse.NAMES)


def test_lexicons_hold_single_stems():
    assert all(w.isalpha() for v in abuse.LEXICONS.values() for w in v.split())


def test_weights_come_from_the_labels():
    rows = [abuse.units(abuse.words(t)[0]) for t in ["çirkin bir gün", "çirkin bir akşam", "güzel bir gün", "güzel bir akşam"]]
    w = abuse.weighed(rows, np.array([1.0, 1, 0, 0]))
    assert w["cirkin"] > 1 and w["guzel"] < -1 and abs(w["bir"]) < 0.1 and w["cirkin bir"] > 1 and "cirkin gun" not in w


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = abuse.Trees().fit(x[:400], y[:400]).margin(x[400:])
    assert ((m > 0) == (y[400:] == 1)).mean() > 0.9
    knots, p = abuse.isotonic(rng.normal(size=200), rng.integers(0, 2, 200).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= -1e-12).all()


def test_scored(spark):
    good, bad = "bugün hava çok güzel sahil yolu {} sakindi", "sen tam bir aptal herifsin {} kes sesini şerefsiz"
    rows = [(i, (bad if i % 3 == 0 else good).format(i)) for i in range(90)] + [(900, None), (901, ""), (902, LONG), (0, bad)]
    df = frame(spark, rows, "post_id bigint, text string").drop("score")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5000, 1)], "post_id bigint, abusive int")
    got = [(r.post_id, r.abusive) for r in abuse.scored(df, labels).collect()]
    assert len(got) == 94 and {i for i, a in got if a} == set(range(0, 90, 3))
    src = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(90)], "_id bigint, source string")
    rate = {r.source: (r.n_texts, r.n_abusive) for r in abuse.rates(abuse.scored(df, labels), src).collect()}
    assert rate == {"a": (31, 11), "b": (60, 20), None: (3, 0)}
    assert abuse.scored(df.limit(0), labels).count() == 0 and abuse.scored(df, labels.limit(0)).where("abusive").count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    posts, labels = spark.read.parquet(f"{d}/posts_processed.parquet"), spark.read.parquet(f"{d}/post_labels.parquet")
    train, test = labels.where("post_id % 3 <> 0"), labels.where("post_id % 3 = 0")
    got = abuse.scored(posts, train)
    x = [(r.abusive, bool(r.y)) for r in got.join(test.withColumnRenamed("abusive", "y"), "post_id").select("abusive", "y").collect()]
    both, true, found = sum(a and y for a, y in x), sum(y for _, y in x), sum(a for a, _ in x)
    # 300 labels, a few of them wrong; with 4,500 recall and precision are 0.95 and more (README)
    assert sum(a == y for a, y in x) / len(x) > 0.9 and both / true > 0.6 and both / found > 0.6
