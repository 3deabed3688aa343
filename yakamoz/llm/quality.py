"""Statistics of a text's words, symbols and lines, and its layout: prose, list, table or junk.

Ratios are native expressions. Layout needs the lines of a text side by side. Three signals say how regular they are: vertical
alignment of delimiters (columns), periodicity of indents and markers, autocorrelation of line lengths. Columns make a table;
periodic markers, lengths that recur and short entries make a list, against the mass of running sentences; word, symbol and
punctuation ratios make junk. The share of common words uses the words that stand in at least COMMON of the distinct texts
that hold their script, counted over the whole corpus; with m distinct words a text there are at most m / COMMON of them a
script, so the list is small at every size. A text without common words may be of a language that few documents have: there
the way it is written decides (``natural``).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.runtime import cut

#: A word is common if this share of the distinct texts with its script has it.
COMMON = 0.01
#: Common words that may go to the driver and the tasks.
MAX_COMMON = 1_000_000
#: Most of a natural text's letters in words that can't be spoken; most odd places (signs or capitals on the wrong side) a word.
NOISE, ODD = 0.2, 0.06
#: Longest lag of the periods sought in markers and line lengths.
LAGS = 6
#: Fewest fields of a table's row; least part of the text in aligned rows.
FIELDS, ALIGNED = 3, 0.5
#: Least structure of a list; what flowing lines count that no sentence sign ends.
LISTED, UNSTOPPED = 0.5, 0.3
# Scripts with a word list of their own, as Unicode names begin.
SCRIPTS = "LATIN CYRILLIC GREEK ARABIC HEBREW ARMENIAN GEORGIAN DEVANAGARI BENGALI TAMIL TELUGU ETHIOPIC HANGUL".split()
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_MARK = re.compile(r"\s*(?:[-*+•▪◦‣·–—☐☑☒✓✔✗→>]\s*|\(?\d{1,3}[.)]\s+|\(?[a-zçğıöşü]\)\s*|\[[ xX]?\]\s*|\d{1,2}[.:]\d{2}\s+|#\d+\s+)(?=\S)")
_LABEL = re.compile(r"\s*[^\W\d_][^.!?:]{0,28}[:=]\s*\S")
_LEADER = re.compile(r"\.{3,}\s*[\d.,:]+\s*[^\W\d_]{0,4}\s*$")
_END = re.compile(r"[.!?…。！？।॥؟۔։።][\"'»”)」』]*\W*$")
_SENTENCE = re.compile(r"[^\W\d_](?:[.!?…।॥؟۔։።]+(?:\s|$)|[。！？])")
_STOPPED = re.compile(r"[.!?…。！？।॥؟۔։።,;:\-–—]\s*$")
#: Letters of scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters.
_UNBROKEN = re.compile(r"[฀-໿ༀ-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
#: Marks belong to the letter before them, joiners to none.
_COMBINING = re.compile("[‌‍" + "".join(chr(c) for c in range(0x300, min(sys.maxunicode, 0x1F000)) if unicodedata.category(chr(c))[0] == "M") + "]+")
_CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщβγδζθκλμνξπρσςτφχψ]{5,}")
_VOWEL = re.compile("[aeiouyıæøœаеёиоуыэюяіїєўъαεηιουω]")
_SPOKEN = re.compile("^[a-zıßæøœłđðþа-яіїєўёα-ως]+$")
#: A capital within a word, a sign before a word instead of after one, words joined by a line.
_WRONG = re.compile(r"[^\W\d_](?<=[a-zçğıöşüß])[A-ZÇĞİÖŞÜ]|\s[,.;:!?]+[^\W\d_]|[^\W_]_+(?=[^\W_])|[^\W_]_+\s|\s_+[^\W_]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_GAP = re.compile(r"\s{2,}")
_RULE = re.compile(r"[\s|+\-=:_]+")
_MOJIBAKE = re.compile(r"[ÃÄÅÂ][\u0080-¿]|[ÃÄÅ]{1}[‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|�")
_BROKEN = re.compile("[ÃÄÅÂ�]")
_LETTER, _BLANK, _SIGN, _UPPER = 1, 2, 4, 8


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Letter, blank, sign and capital bits of the code points of the first three planes."""
    out = np.zeros(0x30000, dtype=np.uint8)
    for cp in range(0x30000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or ch.isalpha():
            out[cp] = _LETTER | (_UPPER if kind in ("Lu", "Lt") else 0)
        elif ch.isspace():
            out[cp] = _BLANK
        elif not ch.isalnum():
            out[cp] = _SIGN
    return out


def _edges(line: str) -> list[int]:
    """Columns at which the fields of a line start and end, if gaps of two or more blanks part them."""
    s = line.strip()
    at = len(line) - len(line.lstrip())
    return [at + x for m in _GAP.finditer(s) for x in (-m.start() - 1, m.end())]


def columns(lines: list[str]) -> tuple[float, int, list[bool]]:
    """Vertical alignment of delimiters: (share of aligned lines, fields of a row, which lines are rows).

    Under tabs, bars, semicolons and commas the n-th delimiters of two lines are one column if both lines have as many; gaps of
    blanks align if fields start or end in the same column. A row has FIELDS fields or more and its delimiters are in
    columns that half of the delimited lines share.
    """
    best = (0.0, 0, [False] * len(lines))
    for d in "\t|;,":
        if sum([d in x for x in lines]) < 2:
            continue
        n = [len(x.strip().strip(d).split(d)) if d in x else 1 for x in lines]
        k, count = Counter([x for x in n if x >= FIELDS]).most_common(1)[0] if any([x >= FIELDS for x in n]) else (0, 0)
        if count < 2:
            continue
        rows = [x == k for x in n]
        if d == ",":  # commas also stand in prose: fields are short and lines don't end as sentences
            rows = [r and not _END.search(s) and max(map(len, s.split(","))) <= 40 for r, s in zip(rows, lines)]
        best = max(best, (sum(rows) / len(lines), k, rows), key=lambda b: b[0])
    edges = [_edges(x.expandtabs()) for x in lines]
    gapped = sum([bool(e) for e in edges])
    if gapped >= 2:
        shared = Counter([c for e in edges for c in set(e)])  # field ends count from the left too: as negative numbers
        held = [sum([max(shared[a], shared[b]) * 2 >= gapped for a, b in zip(e[::2], e[1::2])]) for e in edges]
        inner = [len(e) // 2 for e in edges]
        k = Counter([n + 1 for n in inner if n + 1 >= FIELDS]).most_common(1)
        rows = [n + 1 >= FIELDS and (h * 2 >= n or n + 1 == k[0][0]) for n, h in zip(inner, held)]
        if sum(rows) >= 2:
            best = max(best, (sum(rows) / len(lines), k[0][0], rows), key=lambda b: b[0])
    return best


def periodicity(marks: list[str]) -> float:
    """Of indents and markers, line by line ('' for a bare line): the largest share of lines, over all lags to LAGS, that are
    marked alike with the line a lag before. A block of one lag holds a marker at least, so bare lines have no period."""
    n, best = len(marks), 0.0
    if any(marks):
        for lag in range(1, min(LAGS, n // 2) + 1):
            same = [a == b and any(marks[i : i + lag]) for i, (a, b) in enumerate(zip(marks, marks[lag:]))]
            best = max(best, sum(same) / (n - lag))
    return best


def autocorrelation(x: np.ndarray, lag: int = 1) -> float:
    """Of line lengths; 1 for lines of one length."""
    if len(x) < lag + 2:
        return 0.0
    y = x - x.mean()
    v = float(y @ y)
    return 1.0 if v == 0 else float(y[lag:] @ y[:-lag]) / v


def rhythm(x: np.ndarray) -> float:
    """How far line lengths recur: the best autocorrelation at a lag from 2 to LAGS above that at lag 1 (blocks of long and
    short lines have that too), the lag standing for two turns at least; 1 for lines of one length."""
    if len(x) < 3:
        return 0.0
    one = autocorrelation(x)
    turns = [autocorrelation(x, k) * len(x) / (len(x) - k) for k in range(2, min(LAGS, (len(x) - 1) // 2) + 1)]
    return one if one == 1.0 else min(1.0, max(0.0, max(turns, default=0.0) - max(0.0, one)))


def steadiness(x: np.ndarray, alike: float) -> float:
    """How far lines are entries of one build: even lengths without any run of long or short ones, and openings alike."""
    even = max(0.0, 1 - float(x.std()) / max(1.0, float(x.mean())))
    return even * alike * (1 - abs(autocorrelation(x))) ** 0.5 if len(x) >= 5 else 0.0


def _simple(text: str) -> bool:
    """Whether it has only characters of one 8-bit set, hence no combining marks and no scripts without blanks."""
    try:
        text.encode("cp1254")
    except UnicodeEncodeError:
        return False
    return True


def natural(text: str, words: list[str]) -> bool:
    """Whether the text is written as languages are, whatever its language: its words can be spoken, its signs follow words,
    its capitals begin them. ``words``: in lower case."""
    letters = sum(map(len, words))
    if len(_UNBROKEN.findall(text)) >= 0.5 * letters > 0:
        return len(set("".join(words))) >= min(12, letters / 4)
    base = [_COMBINING.sub("", unicodedata.normalize("NFKD", w)) for w in words]
    noise = sum([len(w) for w in base if len(w) > 30 or _SPOKEN.match(w) and (_CONSONANTS.search(w) or len(w) > 3 and not _VOWEL.search(w))])
    return bool(words) and noise <= NOISE * letters and len(_WRONG.findall(text)) <= ODD * len(words)


def _low(text: str) -> str:
    return text.lower() if "I" not in text and "İ" not in text else text.replace("İ", "i").replace("I", "ı").lower()


def layout(text: str, common: frozenset[str]) -> tuple:
    """(aligned, fields, period, autocorrelation, rhythm, steady, listed, flowing, common words, diversity, capitals, symbols, tags, kind)."""
    unbroken = False
    if not text.isascii() and not _simple(text):
        text = _COMBINING.sub("", unicodedata.normalize("NFC", text))
        unbroken = len(_UNBROKEN.findall(text)) > 0.5 * sum(map(str.isalpha, text))
    whole = [x for x in text.splitlines() if x.strip()]
    lines = [x for x in whole if not (_RULE.fullmatch(x) and len(x.strip()) > 2)]
    words = _WORD.findall(_low(text))
    n = sum([len(w) + 1 >> 1 for w in words]) if unbroken else len(words)
    # by letters: a stray short word in noise says little
    usual = sum([len(w) for w in words if w in common and len(w) > 1])
    if "I" in text:  # other languages have the dotted small letter
        usual = max(usual, sum([len(w) for w in _WORD.findall(text.lower()) if w in common and len(w) > 1]))
    usual /= max(1, sum([x for x in map(len, words) if x > 1]))
    diversity = len(set(words)) / n**0.5 if n else 0.0
    flat = "\n".join(lines)
    kinds = _kinds()[np.minimum(np.frombuffer(flat.encode("utf-32-le", "replace"), dtype="<u4"), 0x2FFFF)]
    letter = (kinds & _LETTER).astype(bool)
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    blanks, signs = text.count(" "), int(np.count_nonzero(kinds & _SIGN))
    visible = max(1, len(flat) - int(np.count_nonzero(kinds & _BLANK)))
    symbols, letters = signs / visible, int(np.count_nonzero(letter)) / visible
    tags = sum(map(len, _TAG.findall(text))) / max(1, len(text)) if "<" in text else 0.0
    capitals = int(np.count_nonzero(start & (kinds & _UPPER > 0))) / max(1, int(np.count_nonzero(start)))
    if not lines:
        return (0.0, 0, *[0.0] * 6, usual, diversity, capitals, symbols, tags, "junk" if text.strip() else None)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    at = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    counts = np.add.reduceat(letter if unbroken else start, at, dtype=np.int64) // (2 if unbroken else 1)
    lengths = lengths.astype(float)
    aligned, k, rows = columns(lines) if len(lines) > 1 else (0.0, 0, [False])
    if len(lines) < len(whole) and not any(rows) and len(lines) > 2:  # box rules frame a table whose cells were cut
        aligned, k, rows = max((aligned, k, rows), columns([x.replace("+", "|") for x in lines]))
    marks, items, flows, leaders, stops = [], [], [], 0, 0
    for s, w in zip(lines, counts.tolist()):
        m = _MARK.match(s)
        mark = m[0] if m else s[: len(s) - len(s.lstrip())] if s[0].isspace() else ""
        w -= m is not None and any(map(str.isalpha, mark))
        leader = "..." in s and bool(_LEADER.search(s))
        ends = not leader and bool(_END.search(s))
        item = leader or (m is not None and w <= 12) or (w <= 9 and bool(_LABEL.match(s))) or (w <= 6 and len(s) - len(mark) <= 60 and not ends)
        item = item and not (ends and w >= 6)
        leaders += leader
        stops += not leader and (ends or bool(_STOPPED.search(s)))
        marks.append(re.sub(r"\w+", "x", mark) if mark else "")
        items.append(item)
        flows.append(not item and (w >= 7 or (ends and w >= 3)))
    total = float(lengths.sum())
    mass = lambda on: float(lengths[np.array(on, dtype=bool)].sum()) / total
    sentences = len(_SENTENCE.findall(text)) / len(lines)
    period, auto, turns = periodicity(marks), autocorrelation(lengths), rhythm(lengths)
    if period < 0.5 and sentences > 0.15 and not leaders:  # short lines of sentences that run on
        flows = [f or (i and not m) for f, i, m in zip(flows, items, marks)]
        items = [i and bool(m) for i, m in zip(items, marks)]
    cells, listed, flowing = mass(rows), mass([i and not r for i, r in zip(items, rows)]), mass([f and not r for f, r in zip(flows, rows)])
    alike = sum([s.lstrip()[0].isupper() or s.lstrip()[0].isdigit() for s in lines]) / len(lines)
    stopped = min(1.0, max(stops / len(lines), sentences))
    steady = steadiness(lengths, alike) if sentences == 0 and not stops else 0.0
    structure = max(listed, max(period, turns, steady) * (1 - stopped))
    known = usual >= 0.3 or natural(text, words)
    longest = max(map(len, text.split()), default=0)
    kind = None
    if tags > 0.3:
        kind = "junk"
    elif len(lines) >= 3 and k >= FIELDS and cells >= ALIGNED and aligned >= ALIGNED and (n or letters < 0.1) and (usual >= 0.1 or known or letters < 0.1 or n < 3):
        kind = "table"
    elif _BROKEN.search(text) and len(_MOJIBAKE.findall(text)) > 0.15 * max(1, n):
        kind = "junk"
    elif len(lines) >= 3 and n and known and structure >= LISTED and structure > flowing * (UNSTOPPED + (1 - UNSTOPPED) * stopped):
        kind = "list"
    elif n < 3:
        kind = "junk" if letters < 0.5 or longest > 25 and not unbroken else None
    elif (
        (n >= 20 and len(set("".join(words) if unbroken else words)) <= 15) or (n >= 8 and capitals > 0.6 and sentences == 0 and diversity < 4)
        or symbols > 0.25 or letters < 0.45 or (usual < 0.22 and not known) or (longest > 60 and blanks < 0.03 * len(text) and not unbroken)
    ):
        kind = "junk"
    return aligned, k, period, auto, turns, steady, listed, flowing, usual, diversity, capitals, symbols, tags, kind


_LAYOUT = (
    "aligned double, fields int, period double, autocorrelation double, rhythm double, steady double, listed double, flowing double, "
    "common_words double, diversity double, capitals double, symbols double, tags double, kind string"
)


@lru_cache(1 << 16)
def _script(ch: str) -> str:
    """The letter's script, '' if it has no word list of its own."""
    name = unicodedata.name(ch, "").split(" ")[0]
    return name if name in SCRIPTS else ""


def common_words(df: DataFrame, column: str = "text", share: float = COMMON) -> frozenset[str]:
    """Words that at least ``share`` of the distinct texts with their script have, counted over all of them; for each script at
    most mean distinct words / share. Copies count once. Words of scripts outside SCRIPTS are measured by all texts. Tasks add
    up words batch by batch. More than MAX_COMMON common words: ValueError."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(r"[^\W\d_]+")
        for b in batches:
            words: Counter = Counter()
            texts: Counter = Counter()  # by script; '' for all
            for t in b.column(0).to_pylist():
                t = _low(t if t.isascii() or _simple(t) else _COMBINING.sub("", unicodedata.normalize("NFC", t)))
                own = set(rx.findall(t))
                words.update(own)
                texts.update({"", *({"LATIN"} if own and _simple(t) else {_script(w[0]) for w in own})})
            keys = [*((_script(w[0]), w) for w in words), *((s, "") for s in texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([*words.values(), *texts.values()], pa.int64())],
                ["s", "w", "n"])

    texts = df.select(F.col(column).alias("t")).where("t IS NOT NULL").distinct()
    total = cut(texts.mapInArrow(count, "s string, w string, n bigint").groupBy("s", "w").agg(F.sum("n").alias("n")))
    least = F.lit(2.0)
    for r in total.where("w = ''").collect():  # one for each script
        least = F.when(F.col("s") == r.s, F.lit(max(2.0, share * r.n))).otherwise(least)
    found = total.where((F.col("w") != "") & (F.col("n") >= least)).select("w").limit(MAX_COMMON + 1).collect()
    if len(found) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return frozenset(r.w for r in found)


def statistics(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row for each row of ``df``: its key and native ratios. Null counts as empty; ratios of empty texts are 0."""
    t = F.coalesce(F.col(column), F.lit(""))
    words = F.filter(F.split(t, r"[ \t\r\n]+"), lambda w: w != "")
    lines = F.filter(F.split(t, r"\n"), lambda x: F.regexp_replace(x, r"[ \t\r]", "") != "")
    x = df.select(F.col(key).alias(key), t.alias("_t"), words.alias("_w"), lines.alias("_l"))
    chars, visible = F.length("_t"), F.length(F.regexp_replace("_t", r"[ \t\r\n]", ""))
    symbols = F.length(F.regexp_replace("_t", r"[\p{L}\p{N} \t\r\n]", ""))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return x.select(
        key, chars.cast("bigint").alias("n_chars"), F.size("_w").cast("bigint").alias("n_words"), F.size("_l").cast("bigint").alias("n_lines"),
        ratio(visible, F.size("_w")).alias("mean_word_length"), ratio(symbols, visible).alias("symbol_ratio"),
        ratio(F.length(F.regexp_replace("_t", r"[^0-9]", "")), visible).alias("digit_ratio"),
        ratio(F.size(F.filter("_l", lambda s: s.rlike(r"[.!?…][ \t\r]*$"))), F.size("_l")).alias("lines_ending_in_punctuation"),
        ratio(F.size(F.array_distinct(F.transform("_w", F.lower))), F.size("_w")).alias("distinct_words"),
    )


def layouts(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row for each row of ``df``: its key, the layout figures and ``kind``: list, table, junk, or null for prose.

    Null and blank texts have kind null and zero figures. Very long texts are read whole; repeated rows give repeated rows;
    an empty table gives an empty result; further columns are ignored.
    """
    common = common_words(df, column)
    x = df.select(F.col(key).cast("bigint").alias(key), F.col(column).alias("text"))
    names = [key, *(f.split()[0] for f in _LAYOUT.split(", "))]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (0.0, 0, *[0.0] * 11, None)
        for b in batches:
            got = [layout(t, common) if t and t.strip() else empty for t in b.column(1).to_pylist()]
            cols = list(zip(*got)) or [()] * 14
            kinds = [pa.float64(), pa.int32(), *[pa.float64()] * 11, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    return x.mapInArrow(read, f"`{key}` bigint, {_LAYOUT}")


def not_prose(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(``doc_id``, ``kind``) of the documents that aren't mainly running prose."""
    return layouts(df, key, column).where("kind IS NOT NULL").select(key, "kind")
