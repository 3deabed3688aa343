"""Column functions on text: cleaning and masking, look-up keys, URLs.

Python's ``\\w`` and ``\\b`` are spelled out as classes of letters, digits and the underscore, since Java's differ.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
_B = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# Placeholder patterns, in the order in which they apply.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = rf"(?U){_B}(?:\+90|0)?\s?(?:5\d{{2}})\s?\d{{3}}\s?\d{{2}}\s?\d{{2}}{_B}"
IDENTITY = rf"(?U){_B}\d{{11}}{_B}"
USERNAME = rf"(?U){_B}(?:[uU]ser(?:name)?\s*[:=]?\s*{_W}+|[uU]ser\s+{_W}+){_B}"
#: The same, told first where they can begin, so that most places of a text fail at once.
_QUICK = {
    EMAIL: "(?<![a-zA-Z0-9_.+-])" + EMAIL.replace("+@", "++@", 1), PHONE: PHONE.replace("(?U)", r"(?U)(?=\+90|0|\s?5)", 1),
    IDENTITY: IDENTITY.replace("(?U)", r"(?U)(?=\d)", 1), USERNAME: USERNAME.replace("(?U)", "(?U)(?=[uU]ser)", 1),
}
# Turkish stop words; a parameter of clean_text.
STOPWORDS = (
    "acaba ama aslında az bazı belki biri birkaç birşey biz bu çok çünkü da daha de defa diye eğer en gibi hem hep hepsi her hiç için "
    "ile ise kez ki kim mı mu mü nasıl ne neden nerde nerede nereye niçin niye o sanki şey siz şu tüm ve veya ya yani"
).split()


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def mask_pii(c: Column) -> Column:
    """E-mail addresses, mobile numbers, identity numbers and user names as [EMAIL], [PHONE], [ID], [USERNAME]."""
    for rx, to in ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (IDENTITY, "[ID]"), (USERNAME, "[USERNAME]")):
        c = F.regexp_replace(c, _QUICK[rx], to)
    return c


def clean_text(
    c: Column, *, urls: bool = True, mentions: bool = True, hashtags: bool = False, emoji: bool = True, pii: bool = True, lower: bool = True,
    punctuation: bool = True, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS), min_length: int = 3,
) -> Column:
    """Cleaned text, null if fewer than ``min_length`` characters remain; the steps apply in the order of the parameters, masking first."""
    if pii:
        c = mask_pii(c)
    if urls:
        c = F.regexp_replace(c, r"(?U)https?://\S+|www\.\S+", "")
    if mentions:
        c = F.regexp_replace(c, rf"(?U)@{_W}+", "")
    if hashtags:
        c = F.regexp_replace(c, rf"(?U)#{_W}+", "")
    if emoji:
        c = F.regexp_replace(c, r"[0-9#*]\x{FE0F}?\x{20E3}|\x{2139}\x{FE0F}?", " ")
    if lower:
        c = turkish_lower(c)
    if punctuation:
        c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", " ")
    c = collapse(F.regexp_replace(c, r"(.)\1{2,}", "$1"))
    if stopwords:
        # white space is one blank by now: a stop word stands between two blanks or ends
        rest: dict[str, list[str]] = {}  # by first letter
        for w in filter(None, stopwords):
            rest.setdefault(w[0], []).append(re.escape(w[1:]))
        listed = "|".join(f"{re.escape(a)}(?:{'|'.join(r)})" for a, r in rest.items())
        c = F.ltrim(F.regexp_replace(F.concat(F.lit(" "), c), f" (?:{listed})(?![^ ])", ""))
    return F.regexp_substr(c, F.lit(rf"(?s)\A.{{{min_length},}}\z"))  # names the long expression once


def lookup_key(c: Column) -> Column:
    """Trimmed, lower case, Turkish letters plain, white space runs as one blank."""
    return F.regexp_replace(F.translate(F.lower(F.trim(c)), "ığüşöç", "igusoc"), r"(?U)\s+", " ")


def slug(c: Column, default: str = "unlisted") -> Column:
    s = F.regexp_replace(lookup_key(c), r"[^a-z0-9\s_-]", "")
    s = F.regexp_replace(F.regexp_replace(F.trim(s), r"\s+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def topic_url(c: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", "")


def start_page(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(c, r"[?&]p=(\d{1,9})(?:&|#|$)", 1).try_cast("int"), F.lit(1)))


def paged_url(url: Column, page: Column) -> Column:
    return F.concat(topic_url(url), F.lit("?p="), page.cast("string"))


def search_query(site: str, province: Column, district: Column, category: Column) -> Column:
    parts = [lookup_key(x) for x in (province, district, category)]
    return F.concat_ws(" ", F.lit(f"site:{site}"), *[F.nullif(p, F.lit("")) for p in parts])


def composite_key(*parts: Column, sep: str = "|||") -> Column:
    """Parts joined; null counts as empty, unlike in concat_ws."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_all(c: Column) -> Column:
    return lookup_key(c).isin("all", "hepsi", "*")
