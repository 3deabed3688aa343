"""Personal information in free text, found and replaced by typed placeholders.

An Aho-Corasick automaton over the folded text finds anchors: at-signs and their spellings, digits and number words, street
words, passport cues, given and family names. At an anchor a deterministic local parser expands the item to both sides and
validates its boundaries. Family names are learned from the corpus: words that follow several given names or initials and
stand mostly there; they are counted over all distinct texts, so that copies of a post count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.llm.lookalikes import plain_rewriter

KINDS = ("email", "phone", "id", "address", "name")
#: A family name: distinct given names before it, least part of its uses that follow one.
LEAST_GIVEN, LEAST_PART = 2, 0.3
#: A word is common, hence no name unless it has a capital and follows a given name, if it stands in this part of the texts.
COMMON = 0.003
#: Learned names that may go to the tasks.
MAX_NAMES = 2_000_000
#: Words to both sides of an anchor that its parser sees at first; twice as many each time that an item comes within EDGE words of the
#: first or last of them.
REACH, EDGE = 16, 4

# Words next to a person's name that aren't part of it.
TITLES = frozenset(
    "sayin dr prof doc av bay bayan hanim bey usta abi abla teyze amca hoca hocam ben bunu imza tesekkurler sahibi sorumlusu "
    "sofor ogretmenimiz ogretmenim doktorumuz muduru mudur mudurumuz komsumuz komsum arkadasim arkadasimiz dayim kuzenim "
    "dedem annem babam rehberimiz esnaf garson taksici avukat avukatim doktor hemsire isletmecisi yetkili yetkilisi adi "
    "soyadi isim ve ile adinda de da lutfen bizi ne sen bu su o bir cok mr mrs ms frau herr the and und".split()
)
# Nouns that make a name before them the name of a place.
PLACES = frozenset(
    "parki park caddesi cadde cad sokagi sokak sok bulvari mahallesi mah meydani durak duragi okulu ilkokulu ortaokulu lisesi "
    "hastanesi camii kafe oteli lokantasi firini pastanesi muzesi kebap pansiyonu kampi pazari balikcisi kitabevi koprusu".split()
)
# Numbers after these words are orders, invoices, parcels, not persons.
BUSINESS = re.compile(r"(?:(?:fatura|siparis|kargo|takip|kod|barkod|fis|abone|rezervasyon|bilet|referans)\w* ?(?:no|kodu|numarasi|numaram|#)|\bkodu?)[ :.#]*$")
# Number words of the digits 0 to 9.
DIGITS = "sifir bir iki uc dort bes alti yedi sekiz dokuz".split()
_UNITS = r"(?! ?(?:dakika|kisi|lira|puan|tl|metre|km|saat|numarali|yil|gun)\b)"
_FOLD = str.maketrans("ıİIğĞüÜşŞöÖçÇâÂîÎûÛ\t\r\v\f\u00a0", "iiigguussooccaaiiuu     ")
_WORD = re.compile(r"[^\W\d_]+")
_AT = r"(?:@| @ | ?[\[({] ?at ?[\])}] ?| at | et | kuyruklu a )"
_DOT = r"(?:\.| ?[\[({] ?(?:nokta|dot|\.) ?[\])}] ?| nokta | dot )"
_EMAIL = re.compile(rf"(?<![\w.+@-])[a-z0-9_][\w.+-]*({_AT})([a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,12}})(?![\w@])")
_RUN = re.compile(r"(?<![\w@#/])(?:\+ ?)?\(?[\do](?:(?:[ .\-/]|\)[ \-]?| ?\()?\d){8,14}(?![\d/])(?!\w)")
_WORDS_RUN = re.compile(rf"\b(?:{'|'.join(DIGITS)})(?:[ ,-]+(?:{'|'.join(DIGITS)})){{9,12}}\b")
_PASSPORT = re.compile(r"pasaport\w*(?: ?(?:no|numarasi|numaram))?[ :.]*([a-z] ?\d{7,9})\b|\bpassport(?: no)?[ :.]*([a-z] ?\d{7,9})\b")
_STREET = re.compile(
    rf"(?:\b[^\W_]+|\d+)\.? +(?:sokak|sokagi|sok|sk|caddesi|cadde|cad|cd|bulvari|bulvar|bulv|blv)\b\.?[ ,:]*"
    rf"(?:(?:kapi )?(?:no|numara|nr)\b ?[.:]* ?)?(\d{{1,4}}(?: ?/ ?\w{{1,4}}\b)?){_UNITS}(?![\d.:]\d)\b"
)
_TOKEN = re.compile(r"\S+")
_CAPITAL = re.compile(r"[A-ZÇĞİÖŞÜ][^\W\d_]+")
_FLAT = re.compile(r"(?: ?(?:kat|daire|k|d) ?[:.]? ?\d{1,3}\b)*")
_GROUPS = re.compile(r"\d+")


def fold(text: str) -> str:
    """Lower case without Turkish accents, of the same length; every blank is a space but line breaks stay."""
    low = text.translate(_FOLD)
    new = low.lower()
    return new if len(new) == len(text) else "".join(c if len(c) == 1 else c[0] for c in map(str.lower, low))


def _phone_or_id(s: str, before: str) -> str | None:
    """Kind of a run of digits and signs between them."""
    digits = "".join(c for c in s.replace("o", "0") if c.isdigit())
    groups = [len(g) for g in _GROUPS.findall(s.replace("o", "0"))]
    plus = s.startswith("+") or digits.startswith("00")
    bare = digits[2:] if digits.startswith("00") else digits
    if BUSINESS.search(before):
        return None
    if plus:
        return "phone" if 10 <= len(bare) <= 14 else None
    if digits[0] == "0":
        return "phone" if len(digits) == 11 and digits[1] in "2345689" else None
    if len(digits) == 12 and digits.startswith("90"):
        return "phone"
    if len(digits) == 10 and digits[0] in "5234" and (len(groups) > 1 or digits[0] == "5"):
        return "phone" if not (len(groups) > 1 and groups[0] != 3) else None
    if len(digits) == 11 and groups in ([11], [3, 3, 3, 2], [3, 3, 5], [3, 2, 2, 2, 2], [5, 6], [2, 3, 3, 3], [1, 10]):
        return "id"
    return None


def _before(text: str, at: int) -> int | None:
    """Start of the word with a capital that stands before ``at``, blanks between; None if there is none."""
    end = len(text[:at].rstrip(" ")) if text[at - 1 : at] == " " else 0
    start = end
    while start and text[start - 1].isalpha():
        start -= 1
    return start if start < end and _CAPITAL.fullmatch(text, start, end) else None


class Finder:
    """Finds items; knows the given and family names and the common words, all folded."""

    def __init__(self, given: frozenset[str], families: frozenset[str], common: frozenset[str]) -> None:
        self.given, self.families, self.common = given, families, common
        a = ahocorasick.Automaton()
        for kind, cues in {
            "email": ("@", "(at)", "[at]", "{at}", "( at", "[ at", " at ", " et ", "kuyruklu"), "digit": tuple("0123456789"),
            "words": tuple(DIGITS), "passport": ("pasaport", "passport"),
            "street": ("sok", " sk", "cad", " cd", "bulv", "blv"), "name": (*families, *given),
        }.items():
            for c in cues:
                a.add_word(c, (*a.get(c, ()), (kind, len(c))))
        a.make_automaton()
        self.automaton = a

    def items(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) without overlaps, in order."""
        t = fold(text)
        spots: dict[str, list[int]] = {}
        for end, hits in self.automaton.iter(t):
            for kind, n in hits:
                at = end - n + 1
                if kind == "digit" and t[at - 1 : at].isdigit() or kind == "name" and (t[at - 1 : at].isalpha() or t[end + 1 : end + 2].isalpha()):
                    continue  # the first digit of a run and whole names only
                spots.setdefault(kind, []).append(at)
        out: list[tuple[int, int, str]] = []

        def free(a: int, b: int) -> bool:
            return all(b <= x or y <= a for x, y, _ in out)

        tokens: list[int] = []  # starts of words between blanks

        def near(kind: str, rx: re.Pattern) -> Iterator[re.Match]:
            """Matches of the local parser that hold an anchor of the kind. It sees whole words around the anchor, of any length,
            and more of them as long as what it finds reaches the first or the last."""
            done = -1
            for p in spots.get(kind, ()):
                if p < done:
                    continue
                if not tokens:
                    tokens.extend(m.start() for m in _TOKEN.finditer(t))
                at, reach = bisect_right(tokens, p), REACH
                while True:
                    first, last = max(0, at - reach), at + reach
                    lo = tokens[first] if first < len(tokens) else 0
                    hi = tokens[last] if last < len(tokens) else len(t)
                    hit = next((m for m in rx.finditer(t, lo, hi) if m.start() <= p < m.end() and m.start() >= done), None)
                    if hit is None or not (first and hit.start() <= tokens[first + EDGE] or last < len(tokens) and hit.end() >= tokens[last - EDGE]):
                        break
                    reach *= 2
                if hit:
                    yield hit
                    done = hit.end()

        for m in near("email", _EMAIL):
            at = m[1].strip()
            if (at not in ("et", "at") or "nokta" in m[2] or "dot" in m[2]) and free(*m.span()):
                out.append((*m.span(), "email"))
        if "digit" in spots:
            for m in near("passport", _PASSPORT):
                g = 1 if m[1] else 2
                if free(*m.span(g)):
                    out.append((*m.span(g), "id"))
            for m in near("street", _STREET):
                a, b = m.span()
                while (w := _before(text, a)) is not None:  # the rest of the street's name
                    a = w
                b = _FLAT.match(t, b).end()
                if free(a, b):
                    out.append((a, b, "address"))
            for m in near("digit", _RUN) if sum(map(t.count, "0123456789")) >= 9 else ():
                kind = _phone_or_id(m[0], t[max(0, m.start() - 30) : m.start()])
                if kind and free(*m.span()):
                    out.append((*m.span(), kind))
        for m in near("words", _WORDS_RUN) if len(spots.get("words", ())) >= 10 else ():
            ws = re.findall(r"[a-z]+", m[0])
            if free(*m.span()):
                out.append((*m.span(), "phone" if ws[0] == "sifir" or (len(ws) == 10 and ws[0] == "bes") else "id"))
        if "name" in spots:
            out += [(a, b, "name") for a, b in self.names(text, t) if free(a, b)]
        return sorted(out)

    def names(self, text: str, t: str) -> list[tuple[int, int]]:
        ws = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(t)]
        caps = [text[a].isupper() for a, _, _ in ws]
        titled = sum(caps) > 0.6 * len(ws)  # capitals say nothing here
        out = []

        def gap(i: int, j: int) -> str:
            return t[ws[i][1] : ws[j][0]]

        def joined(i: int, j: int) -> bool:
            return 0 <= i and j < len(ws) and gap(i, j).strip(" ") == "" and gap(i, j) != ""

        def initial(i: int) -> bool:
            return i >= 0 and i + 1 < len(ws) and len(ws[i][2]) == 1 and re.fullmatch(r"\. ?", gap(i, i + 1)) is not None

        def unknown(i: int, common: bool = False) -> bool:
            w = ws[i][2]
            return len(w) >= 3 and (common or w not in self.common) and w not in TITLES and w not in PLACES and w not in self.families

        def place(i: int) -> bool:
            return i < len(ws) and joined(i - 1, i) and ws[i][2] in PLACES

        for k, (a, b, w) in enumerate(ws):
            if out and a < out[-1][1]:
                continue
            if t[a - 1 : a] in ("@", "#", "/", "_", ".") or t[b : b + 1] in ("@", "_"):
                if not (t[a - 1 : a] == "." and initial(k - 1)):
                    continue
            if w in self.families and w not in self.common:
                first = k
                while first > 0 and (
                    initial(first - 1) or (joined(first - 1, first) and (ws[first - 1][2] in self.given or (first == k and unknown(first - 1) and (caps[first - 1] == caps[k]))))
                ):
                    first -= 1
                while first < k and first > 0 and joined(first - 1, first) and first - 1 >= k - 3 and unknown(first - 1) and caps[first - 1] and not titled:
                    first -= 1
                if first < k and not place(k + 1):
                    out.append((ws[first][0], b))
                    continue
                if k + 1 < len(ws) and re.fullmatch(r", ?| ", gap(k, k + 1)):  # family name first
                    n = ws[k + 1][2]
                    if n in self.given and not (k + 2 < len(ws) and joined(k + 1, k + 2) and ws[k + 2][2] in self.families):
                        out.append((a, ws[k + 1][1]))
                    elif initial(k + 1) or (len(n) == 1 and t[ws[k + 1][1] : ws[k + 1][1] + 1] == "."):
                        out.append((a, ws[k + 1][1] + 1))
                    elif gap(k, k + 1).startswith(",") and unknown(k + 1) and caps[k] and caps[k + 1] and not titled and not place(k + 2):
                        out.append((a, ws[k + 1][1]))
            elif w in self.given and caps[k] and not titled:  # a family name that wasn't learned
                if joined(k, k + 1) and joined(k + 1, k + 2) and ws[k + 2][2] in self.families:
                    continue  # two given names; the family name finds them
                if joined(k, k + 1) and caps[k + 1] and unknown(k + 1, common=True) and ws[k + 1][2] not in self.given and not place(k + 2):
                    out.append((a, ws[k + 1][1]))
        return out


def masked(text: str, items: list[tuple[int, int, str]]) -> str:
    """The text with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] for the items."""
    out, at = [], 0
    for a, b, kind in items:
        out += text[at:a], f"[{kind.upper()}]"
        at = b
    return "".join((*out, text[at:]))


@lru_cache(2)
def _finder(given: frozenset[str], families: frozenset[str], common: frozenset[str]) -> Finder:
    return Finder(given, families, common)


def learned(texts: DataFrame, given: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """(family names, common words) of the only column, counted over its distinct texts. Tasks add up words batch by batch; a word's
    given names are kept as bits of a hash."""
    bit = {g: 1 << (i % 62) for i, g in enumerate(sorted(given))}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(r"[^\W\d_]+|\n|[^\w\s]")
        for b in batches:
            n, after, bits = Counter(), Counter(), {}
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                ws = rx.findall(fold(t))
                n.update({w for w in ws if len(w) > 1})
                for i, w in enumerate(ws[1:], 1):
                    if len(w) < 3 or w in TITLES or not w.isalpha():
                        continue
                    p = ws[i - 1]
                    one = bit.get(p, 0) or (1 << 62 if p == "." and i > 1 and len(ws[i - 2]) == 1 else 0)
                    if one:
                        after[w] += 1
                        bits[w] = bits.get(w, 0) | one
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([after.get(k, 0) for k in keys], pa.int64()),
                 pa.array([bits.get(k, 0) for k in keys], pa.int64())], ["w", "n", "after", "bits"])

    total = texts.select(F.count_distinct(F.xxhash64(texts.columns[0]))).first()[0]
    x = texts.distinct().mapInArrow(count, "w string, n bigint, after bigint, bits bigint").groupBy("w").agg(
        F.sum("n").alias("n"), F.sum("after").alias("after"), F.bit_or("bits").alias("bits"))
    common = F.col("n") >= max(8, COMMON * total)
    family = (F.bit_count("bits") >= LEAST_GIVEN) & (F.col("after") >= LEAST_PART * F.col("n"))
    rows = x.where(common | family).select("w", common.alias("c"), family.alias("f")).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} learned names and common words")
    families = frozenset(r.w for r in rows if r.f) - given
    return families, frozenset(r.w for r in rows if r.c) - families


def personal_items(df: DataFrame, names: DataFrame, key: str = "_id", column: str = "text") -> DataFrame:
    """(``raw_id`` bigint, ``kinds`` array<string>, ``n_items`` int, ``masked`` string) for each row of ``df``.

    Items are sought in the consistent form of look-alike characters, which is also what ``masked`` keeps of the rest. Null
    stays null, empty stays empty, both without items; texts of any length are read whole; overlapping items go to the kind
    found first (e-mail, identity, address, phone, name); repeated rows give repeated rows; an empty table gives an empty
    result; further columns are ignored. ``names`` holds known given names (column ``name``), MAX_NAMES at most.
    """
    listed = names.select("name").where("name IS NOT NULL").limit(MAX_NAMES + 1).collect()
    if len(listed) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    given = frozenset(fold(r.name.strip()) for r in listed)
    families, common = learned(df.select(column), given)
    shared = df.sparkSession.sparkContext.broadcast((given, families, common))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, form = _finder(*shared.value), plain_rewriter()
        for b in batches:
            kinds, n, text = [], [], []
            for t in b.column(1).to_pylist():
                if not t:
                    kinds.append([])
                    n.append(0)
                    text.append(t)
                    continue
                t = form(t)
                got = finder.items(t)
                kinds.append(sorted({k for _, _, k in got}))
                n.append(len(got))
                text.append(masked(t, got))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(n, pa.int32()), pa.array(text, pa.string())],
                ["raw_id", "kinds", "n_items", "masked"])

    x = df.select(F.col(key).cast("bigint").alias("raw_id"), F.col(column).alias("text"))
    return x.mapInArrow(find, "raw_id bigint, kinds array<string>, n_items int, masked string")


def personal_kinds(df: DataFrame, names: DataFrame, key: str = "_id", column: str = "text") -> DataFrame:
    """(``raw_id``, ``kind``): one row for each text and kind of item that it holds."""
    return personal_items(df, names, key, column).select("raw_id", F.explode("kinds").alias("kind"))
