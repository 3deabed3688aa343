"""Abusive, hateful and sexual content: a score for every text, rates for every source.

Gradient-boosted trees over dense features, fitted on a bounded sample of labelled rows, with isotonic calibration on held-out
folds. The features are densities: of general lexicons (single stems), of words and word pairs weighted by what the labelled
rows say about them, of second-person words and of lexicon words near them, of capitals, punctuation and obfuscation.
Weights of words are learned on other folds than the row they describe. Scoring is one pass over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.llm.lookalikes import plain_rewriter

#: Labelled rows used at most; beyond that those of the smallest hashes.
MAX_LABELS = 20_000
#: Trees, their depth, learning rate, least rows in a leaf, ridge on leaf values, bins, folds of the calibration.
TREES, DEPTH, RATE, LEAF, RIDGE, BINS, FOLDS = 80, 3, 0.15, 3, 1.0, 48, 5
#: Texts of this score or more count as abusive.
ABUSIVE = 0.5
#: Rows that a weighed word or pair stands in at least; rows added to each side; words to both sides that count as near; weight from
#: which a word is telling; letters of a word's stem.
SUPPORT, PRIOR, NEAR, TELLING, STEM = 2, 0.3, 4, 2.0, 7

# General lexicons of single stems, Turkish letters folded; Turkish, English, German.
LEXICONS = {
    "insults": (
        "aptal salak gerizekali embesil dangalak surtuk kancik yavsak serefsiz haysiyetsiz namussuz ahlaksiz soysuz beyinsiz orospu kahpe gavat "
        "pezevenk ibne godos sersem ahmak budala asagilik karaktersiz onursuz rezil hain itoglu kaltak densiz terbiyesiz edepsiz soytari dalkavuk "
        "idiot moron bitch whore bastard asshole scum stupid loser arschloch hurensohn schlampe missgeburt idiot dummkopf"
    ),
    "animals": "mal okuz domuz kopek hiyar kasar alcak pislik pic esek manyak hayvan maymun ayi inek yilan sican pig dog swine",
    "threats": "oldur gebert gomer kirar doker parcala bogar ezer yakar keser vurur dover dagit pisman bulur kill hurt stab shoot",
    "hate": "mikrop hasere parazit geber defol yaratik surusu irk kokunuz soyunuz gebersin kahrol vermin subhuman ungeziefer untermensch",
    "sexual": "sevis ciplak becer gogus meme yala kalca kulot azgin orgazm seks soyun yatag emmek porno penis vajina blowjob porn horny nude",
    "contempt": "utan tukur yazik lanet igrenc tiksin midesiz cirkef seviyesiz cahil zavalli ucube disgusting pathetic",
}
ADDRESS = frozenset("sen seni sana senin senden sensin siz sizi size sizin sizden hepiniz ulan lan kendini herif you your du dich deine".split())
_PLAIN = tuple(zip("ığüşöçâîû", "igusocaiu"))
_LEET = str.maketrans("013457@$!", "oieastasi")
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*.][^\W_]+)*")
_REPEAT = re.compile(r"(.)\1+")
_VOWELS = re.compile("[aeiou]")
_MIXED = re.compile(r"[a-z][013457@$!]|[013457@$!][a-z]")
_ENDING = re.compile(r"(?:siniz|sin|lar|ler|larin|sunuz|dir)?$")


def _squeezed(w: str) -> str:
    return _REPEAT.sub(r"\1", w)


_KINDS = tuple(LEXICONS)
_STEMS = {k: tuple(map(_squeezed, v.split())) for k, v in LEXICONS.items()}
_ALL = frozenset(w for k in ("insults", "animals") for w in _STEMS[k] if len(w) > 3)
_BONES = {b: w for w in sorted(_ALL) if len(b := _VOWELS.sub("", w)) >= 3}
#: A word with a sign in place of a letter, or between letters, leaves two pieces behind.
_BROKEN = frozenset((w[:i], w[i + k :]) for w in _ALL if len(w) >= 5 for i in range(1, len(w)) for k in (0, 1) if w[i + k :])


#: First three letters -> (lexicon, stem, whether it takes only endings of names and persons).
_FIRST: dict[str, list[tuple[int, str, bool]]] = {}
for _k, _name in enumerate(_KINDS):
    for _s in _STEMS[_name]:
        _FIRST.setdefault(_s[:3], []).append((_k, _s, _name == "animals" or len(_s) <= 3))


@lru_cache(1 << 16)
def _kind(w: str) -> int:
    """Number of the lexicon whose stem the word has, -1 for none."""
    for k, s, short in _FIRST.get(w[:3], ()):
        if w.startswith(s) and (not short or _ENDING.fullmatch(w[len(s) :])):
            return k
    return -1


def _whole(a: str, b: str) -> str | None:
    """The lexicon word whose pieces a and b are, one letter missing at most."""
    if len(a) + len(b) < 4:
        return None
    return next((w for w in _ALL if w.startswith(a) and w.endswith(b) and len(w) - len(a) - len(b) in (0, 1)), None)


def folded(text: str) -> str:
    """Lower case without Turkish accents; i, ı, İ and I are one letter."""
    low = text.replace("İ", "i").lower()
    if not low.isascii():
        for a, b in _PLAIN:
            low = low.replace(a, b)
    return low


def words(text: str | None) -> tuple[list[str], int, int, float]:
    """(folded words, how many were disguised, how many stood in pieces, share of signs): doubled letters once, letters in place of
    digits and signs, letters apart as one word, lexicon words whole whose vowels or one letter are missing."""
    raw = folded(plain_rewriter()(text)) if text else ""
    tokens = _TOKEN.findall(raw)
    visible = sum(map(len, raw.split()))
    signs = (visible - sum(map(len, tokens))) / max(1, visible)
    out: list[str] = []
    hidden, pieces, run = 0, 0, ""
    for w in [*_TOKEN.findall(_squeezed(raw)), ""]:
        if w and not w.isalpha():
            if _MIXED.search(w) and sum(map(str.isalpha, w)) >= 2:
                hidden += 1
                w = _squeezed(w.translate(_LEET))
            w = "0" if w.isdigit() else "".join(filter(str.isalnum, w))
        if len(w) == 1 and w.isalpha():
            run += w
            continue
        if run:
            apart = len(run) > 2
            pieces += apart
            out += [_squeezed(run)] if apart else list(run)
            run = ""
        if not w:
            continue
        if out and (out[-1], w) in _BROKEN and (whole := _whole(out[-1], w)):
            out[-1] = whole
            pieces += 1
        elif len(w) > 2 and w in _BONES and not _VOWELS.search(w):
            out.append(_BONES[w])
            pieces += 1
        else:
            out.append(w)
    return out, hidden, pieces, signs


NAMES = (
    *(f"{k}_density" for k in _KINDS), *(f"{k}_near_you" for k in _KINDS), "address_density", "top_weight", "top_three", "telling_density",
    "mean_weight", "top_pair", "top_three_pairs", "telling_pairs", "weight_near_you", "capitals", "punctuation", "exclamations", "disguised_density", "pieces_density",
)


def units(ws: list[str]) -> tuple[list[str], list[str]]:
    """Stems and pairs of neighbouring ones."""
    stems = [w[:STEM] for w in ws]
    return stems, [f"{a} {b}" for a, b in zip(stems, stems[1:])]


def weighed(rows: list[tuple[list[str], list[str]]], labels: np.ndarray) -> dict[str, float]:
    """Log odds of words and pairs in abusive against other labelled rows."""
    a, b = Counter(), Counter()
    for us, y in zip(rows, labels):
        (a if y else b).update({u for part in us for u in part})
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())
    return {u: float(np.log((a[u] + PRIOR) / (pos + 1)) - np.log((b[u] + PRIOR) / (neg + 1))) for u in {*a, *b} if a[u] + b[u] >= SUPPORT}


def features(text: str | None, found: tuple[list[str], int, int, float], weights: dict[str, float]) -> list[float]:
    """The dense features of a text and its words(); of an empty text all 0."""
    ws, hidden, pieces, signs = found
    n = max(1, len(ws))
    address = [i for i, w in enumerate(ws) if w in ADDRESS or (len(w) > 6 and w.endswith(("siniz", "sunuz")))]
    near = {j for i in address for j in range(i - NEAR, i + NEAR + 1)}
    count, close = [0] * len(_KINDS), [0.0] * len(_KINDS)
    for i, k in enumerate(map(_kind, ws)):
        if k >= 0:
            count[k] += 1
            close[k] += i in near
    one, two = ([weights.get(u, 0.0) for u in us] for us in units(ws))
    top, top2 = sorted(one, reverse=True)[:3] or [0.0], sorted(two, reverse=True)[:3] or [0.0]
    raw = text or ""
    return [
        *(c / n for c in count), *close, len(address) / n, top[0], sum(top), sum([x > TELLING for x in one]) / n, sum(one) / n, top2[0], sum(top2),
        float(sum([x > TELLING for x in two])), max([one[i] for i in near if 0 <= i < len(one)], default=0.0),
        0.0 if raw.islower() else sum(map(str.isupper, raw)) / max(1, len(raw)), signs, float(raw.count("!")), hidden / n, pieces / n,
    ]


class Trees:
    """Gradient-boosted regression trees on the logistic loss, with binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS), method="nearest")) for j in range(x.shape[1])] if len(x) else []
        binned = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]) if len(x) else x
        f = np.full(len(y), self.base)
        for _ in range(TREES if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - p, p * (1 - p), cuts, np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += RATE * self._value(tree, x)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, rows: np.ndarray, depth: int) -> tuple:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAF:
            for j, c in enumerate(cuts):
                if len(c) < 2:
                    continue
                own = b[rows, j]
                sg, sh, sn = (np.cumsum(np.bincount(own, w, len(c) + 1))[: len(c) - 1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = sg**2 / (sh + RIDGE) + (total_g - sg) ** 2 / (total_h - sh + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(sn < LEAF) | (len(rows) - sn < LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        _, j, k = best
        if j is None:
            return (float(total_g / (total_h + RIDGE)),)
        left = b[rows, j] <= k
        return j, float(cuts[j][k]), self._grow(b, g, h, cuts, rows[left], depth - 1), self._grow(b, g, h, cuts, rows[~left], depth - 1)

    def _value(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        """Of each row: down a complete binary tree, laid out level by level."""
        feature, cut, leaf = _complete(tree)
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return leaf[at - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += RATE * self._value(t, x)
        return out


def _complete(tree: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, leaf values) of a tree filled up to DEPTH; a node that has no cut sends everything left."""
    feature, cut, level = [], [], [tree]
    for _ in range(DEPTH):
        feature += [t[0] if len(t) > 1 else 0 for t in level]
        cut += [t[1] if len(t) > 1 else np.inf for t in level]
        level = [x for t in level for x in (t[2:] if len(t) > 1 else (t, t))]
    return np.array(feature, dtype=np.int64), np.array(cut), np.array([t[0] for t in level])


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing (margin, probability) knots."""
    blocks: list[list[float]] = []
    for m, v in sorted(zip(margin.tolist(), y.tolist())):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, m2]
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])


class Classifier:
    """Weights of words, trees and their calibration."""

    def __init__(self, texts: list[str | None], labels: list[int]) -> None:
        y = np.array(labels, dtype=float)
        found = [words(t) for t in texts]
        rows = [units(f[0]) for f in found]
        fold = np.arange(len(y)) % min(FOLDS, max(2, len(y) // 2))
        x = np.zeros((len(y), len(NAMES)))
        for k in set(fold.tolist()):  # a row's own label never weighs its words
            w = weighed([r for r, f in zip(rows, fold) if f != k], y[fold != k])
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i], found[i], w)
        self.weights, self.trees = weighed(rows, y), Trees().fit(x, y)
        held = np.zeros(len(y))
        for k in set(fold.tolist()) if len(y) > 3 else ():
            held[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots = isotonic(held, y) if len(y) > 3 else (np.array([0.0]), np.array([0.0]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m = self.trees.margin(np.array([features(t, words(t), self.weights) for t in texts]))
        return np.interp(m, *self.knots)


def trained(posts: DataFrame, labels: DataFrame, key: str = "post_id", column: str = "text") -> Classifier:
    """A classifier of at most MAX_LABELS labelled rows (column ``abusive``, 0 or 1)."""
    own = labels.select(F.col(key).alias("_k"), F.col("abusive").cast("int").alias("_y")).where("_k IS NOT NULL AND _y IN (0, 1)")
    own = own.orderBy(F.xxhash64("_k"), "_k", "_y").limit(MAX_LABELS)
    rows = posts.join(F.broadcast(own), F.col(key) == F.col("_k")).select("_k", "_y", F.col(column).alias("_t")).collect()  # MAX_LABELS at most
    rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))
    order = np.random.default_rng(1).permutation(len(rows))
    return Classifier([rows[i][2] for i in order], [rows[i][1] for i in order])


def scored(posts: DataFrame, labels: DataFrame, key: str = "post_id", column: str = "text") -> DataFrame:
    """(key, ``score`` double, ``abusive`` boolean) for each row of ``posts``.

    Null and empty texts score as a text without any words; long texts are read whole; repeated rows give repeated rows; an
    empty table gives an empty result; without labels, or with those of one class only, every text gets the rate of that
    class. Further columns are ignored.
    """
    shared = posts.sparkSession.sparkContext.broadcast(trained(posts, labels, key, column))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= ABUSIVE)], [key, "score", "abusive"])

    x = posts.select(F.col(key).cast("bigint").alias(key), F.col(column).alias("text"))
    return x.mapInArrow(score, f"`{key}` bigint, score double, abusive boolean")


def rates(scores: DataFrame, sources: DataFrame, key: str = "post_id", source_key: str = "_id", source: str = "source") -> DataFrame:
    """(``source``, ``n_texts``, ``n_abusive``, ``rate``, ``mean_score``): by source; texts without one count under null."""
    of = sources.select(F.col(source_key).alias("_s"), F.col(source).alias("source"))
    x = scores.join(of, F.col(key) == F.col("_s"), "left")
    return x.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.count_if("abusive").alias("n_abusive"),
        (F.count_if("abusive") / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"),
    )
