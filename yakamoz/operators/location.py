"""Places named in texts, by a gazetteer.

A gazetteer is built from (province, district) rows: provinces and districts are candidates, the longest first; a district
beats any province; a name that several provinces share belongs to the first. A text names a candidate if its words stand
there in a row, parted as in the name. The gazetteer is small: a map from candidates to their entries, in which each run of
a text's words is looked up within one projection. No pattern for each name, no join, no shuffle.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakamoz.functions.text import turkish_lower

#: Rows of a gazetteer that may be broadcast.
MAX_GAZETTEER = 100_000
# Provinces in the order of their codes TR-01 to TR-81.
PROVINCES = (
    "Adana Adıyaman Afyonkarahisar Ağrı Amasya Ankara Antalya Artvin Aydın Balıkesir Bilecik Bingöl Bitlis Bolu Burdur Bursa "
    "Çanakkale Çankırı Çorum Denizli Diyarbakır Edirne Elazığ Erzincan Erzurum Eskişehir Gaziantep Giresun Gümüşhane Hakkari Hatay "
    "Isparta Mersin İstanbul İzmir Kars Kastamonu Kayseri Kırklareli Kırşehir Kocaeli Konya Kütahya Malatya Manisa Kahramanmaraş "
    "Mardin Muğla Muş Nevşehir Niğde Ordu Rize Sakarya Samsun Siirt Sinop Sivas Tekirdağ Tokat Trabzon Tunceli Şanlıurfa Uşak Van "
    "Yozgat Zonguldak Aksaray Bayburt Karaman Kırıkkale Batman Şırnak Bartın Ardahan Iğdır Yalova Karabük Kilis Osmaniye Düzce"
).split()
_LETTERS = "[^a-zA-ZğüşıöçĞÜŞİÖÇ]+"
_PIECES = "[a-zA-ZğüşıöçĞÜŞİÖÇ]+|[^a-zA-ZğüşıöçĞÜŞİÖÇ]+"
_LETTER = "[a-zA-ZğüşıöçĞÜŞİÖÇ]"
_TABLE = "array<map<string, struct<is_province: boolean, rank: int, province: string, district: string>>>"


def gazetteer(places: DataFrame) -> list[tuple[str, bool, int, str, str]]:
    """(candidate, whether it is a province, rank, province, district) of (``ord``, ``province``, ``district``); a blank district
    stands for the province itself. Of equal candidates a province comes first, then the first row; rank goes by length."""
    rows = places.select("ord", F.coalesce("province", F.lit("")), F.coalesce("district", F.lit(""))).limit(MAX_GAZETTEER + 1).collect()
    if len(rows) > MAX_GAZETTEER:
        raise ValueError(f"more than {MAX_GAZETTEER} gazetteer rows")
    first: dict[str, tuple] = {}
    for ord_, p, d in sorted(rows, key=lambda r: (r[2] != "", r[0])):
        name = (d or p).replace("İ", "i").replace("I", "ı").lower()
        if re.search(_LETTER, name):
            first.setdefault(" ".join(name.split()), (d == "", ord_, p, d))
    ranked = sorted(first.items(), key=lambda x: (-len(x[0]), x[1][1], x[0]))
    return [(c, is_province, i, p, d) for i, (c, (is_province, _, p, d)) in enumerate(ranked, 1)]


def runs(text: Column, longest: int) -> Column:
    """Runs of up to ``longest`` words of a text, as they are written but for white space, which is one blank."""
    t = F.regexp_replace(turkish_lower(text), r"(?U)\s+", " ")
    one = F.filter(F.split(t, _LETTERS), lambda x: x != "")
    if longest == 1:
        return F.array_distinct(one)
    # words and what parts them in turns: a run of k words has 2 k - 1 of them
    parts = F.regexp_extract_all(t, F.lit(_PIECES), 0)
    joined = lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 2 * k + 2)), lambda i: F.array_join(F.slice(parts, i, 2 * k - 1), ""))
    return F.array_distinct(F.concat(one, *[F.when(F.size(parts) >= 2 * k - 1, joined(k)).otherwise(F.array().cast("array<string>")) for k in range(2, longest + 1)]))


def tagged(posts: DataFrame, places: DataFrame, key: str = "post_id", text: str = "text", tags: str | None = None) -> DataFrame:
    """(key, ``province``, ``district``) for each post: the first tag that names a place, else the text; '' for none.

    Null and empty texts and tags name nothing; texts are read whole; repeated rows give repeated rows; an empty gazetteer
    tags nothing; further columns are ignored. More than MAX_GAZETTEER places: ValueError.
    """
    rows = gazetteer(places)
    if not rows:
        return posts.select(key, F.lit("").alias("province"), F.lit("").alias("district"))
    longest = max(len([w for w in re.split(_LETTERS, r[0]) if w]) for r in rows)
    # a hash table, as an array of short maps, since the key of a map is sought one by one; a constant of the plan
    size = 1 << (2 * len(rows)).bit_length()
    at: list[dict] = [{} for _ in range(size)]
    for c, *e in rows:
        at[zlib.crc32(c.encode()) % size][c] = dict(zip(("is_province", "rank", "province", "district"), e))
    known = F.from_json(F.lit(json.dumps(at, ensure_ascii=False)), _TABLE)
    entry = lambda c: F.try_element_at(F.get(known, (F.crc32(c.cast("binary")) % size).cast("int")), c)
    found = lambda t: F.array_min(F.filter(F.transform(runs(t, longest), entry), lambda e: e.isNotNull()))
    best = found(F.col(text))
    if tags:
        of_tags = F.filter(F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), found), lambda e: e.isNotNull())
        best = F.coalesce(F.get(of_tags, F.lit(0)), best)
    return posts.select(key, best.alias("_b")).select(key, *[F.coalesce(F.col(f"_b.{c}"), F.lit("")).alias(c) for c in ("province", "district")])


def province_code(c: Column) -> Column:
    """ISO 3166-2 code of a province, TR-?? for others."""
    codes = F.create_map(*[F.lit(v) for i, p in enumerate(PROVINCES, 1) for v in (p, f"TR-{i:02d}")])
    return F.coalesce(F.try_element_at(codes, c), F.lit("TR-??"))
