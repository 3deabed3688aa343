"""Own baseline: the headline operators on the reference's kind of engine, one Python process that loops over documents.

Prints one JSON line: seconds by query at $BENCH_SF_DIR, reading the table into dictionaries included, the best of 3 runs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections import Counter, defaultdict
from datetime import datetime, timezone

import pyarrow.parquet as pq

from yakamoz.functions.text import STOPWORDS

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SINCE, UNTIL = datetime(1950, 1, 1), datetime(2026, 12, 31)
LABELS = ("positive", "negative")


def docs(name: str, *columns: str) -> list[dict]:
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(columns) or None).to_pylist()


def polar(rows: list[dict]) -> Counter:
    out: Counter = Counter()
    for model in ("llm", "transformer"):
        for r in rows:
            label = (r["sentiment"][model]["label"] or "").lower()
            if label in LABELS and (r["location"] or {}).get("province") and SINCE <= r["created_at"] <= UNTIL:
                out[r["location"]["province"], model, label] += 1
    return out


def province_sentiment() -> object:
    n = polar(docs("posts_processed", "sentiment", "location", "created_at"))
    keys = {k[:2] for k in n}
    return {k: (n[*k, "positive"] - n[*k, "negative"]) / (n[*k, "positive"] + n[*k, "negative"]) for k in keys}


def located(r: dict) -> tuple[str, str]:
    p, d = ((r["location"] or {}).get(x) or "" for x in ("province", "district"))
    p, d = p.strip(), d.strip()
    return (p, d or p) if p else ("Unknown", "Unknown")


def map_two_grain() -> object:
    out: dict = defaultdict(Counter)
    for r in docs("posts_processed", "sentiment", "location"):
        p, d = located(r)
        for model in ("llm", "transformer"):
            label = (r["sentiment"][model]["label"] or "neutral").lower().strip()
            label = label if label in LABELS else "neutral"
            out[p, None, model][label] += 1
            out[p, d, model][label] += 1
    return {k: ((c["positive"] - c["negative"]) / sum(c.values()) + 1) / 2 for k, c in out.items()}


def map_category_breakdown() -> object:
    tags = {r["_id"]: (r["post_tags"] or [None])[0] if r["post_tags"] else None for r in docs("posts_raw", "_id", "post_tags")}
    out: dict = defaultdict(Counter)
    for r in docs("posts_processed", "post_id", "sentiment", "location"):
        category = (tags.get(r["post_id"]) or "uncategorized").lower().strip()
        for model in ("llm", "transformer"):
            out[located(r)[0], model, category][(r["sentiment"][model]["label"] or "neutral").lower().strip()] += 1
    return {k: ((c["positive"] - c["negative"]) / sum(c.values()) + 1) / 2 for k, c in out.items()}


def geo_metadata() -> object:
    at = [located(r) for r in docs("posts_processed", "location")]
    return sum(p == "Unknown" for p, _ in at), len({p for p, _ in at}), len(set(at))


MASKS = (
    (re.compile(r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"), "[EMAIL]"), (re.compile(r"\b(?:\+90|0)?\s?5\d{2}\s?\d{3}\s?\d{2}\s?\d{2}\b"), "[PHONE]"),
    (re.compile(r"\b\d{11}\b"), "[ID]"), (re.compile(r"\b(?:[uU]ser(?:name)?\s*[:=]?\s*\w+|[uU]ser\s+\w+)\b"), "[USERNAME]"),
    (re.compile(r"https?://\S+|www\.\S+"), ""), (re.compile(r"@\w+"), ""),
)
SIGNS, REPEATS, BLANKS, STOP = re.compile(r"[^\w\s]"), re.compile(r"(.)\1{2,}"), re.compile(r"\s+"), frozenset(STOPWORDS)


def clean_text() -> object:
    out = []
    for r in docs("posts_raw", "_id", "text"):
        t = r["text"]
        if t is not None:
            for rx, to in MASKS:
                t = rx.sub(to, t)
            t = SIGNS.sub(" ", t.replace("İ", "i").replace("I", "ı").lower())
            t = " ".join(w for w in BLANKS.sub(" ", REPEATS.sub(r"\1", t)).split() if w not in STOP)
        out.append((r["_id"], t if t and len(t) >= 3 else None))
    return out


def text_fingerprint_dedupe() -> object:
    seen, out = set(), []
    for r in sorted(docs("posts_raw", "_id", "topic_url", "text"), key=lambda r: r["_id"]):
        form = BLANKS.sub(" ", (r["text"] or "").strip().lower())
        key = (r["topic_url"], hashlib.sha1(form.encode()).hexdigest() if form else "")
        if not form or key not in seen:
            seen.add(key)
            out.append((r["_id"], *key))
    return out


FORMATS = ("%d.%m.%Y %H:%M", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def parsed(value: str | None) -> datetime | None:
    t = BLANKS.sub(" ", re.sub(" ?tarihinde", "", value or "")).strip()
    for f in FORMATS:
        try:
            return datetime.strptime(t, f).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    try:
        return datetime.fromisoformat(t)
    except ValueError:
        return None


def parse_dates() -> object:
    return [(r["_id"], parsed(r["created_at"])) for r in docs("posts_raw", "_id", "created_at")]


def validate_records() -> object:
    out = []
    for r in docs("posts_raw", "_id", "text", "source", "language", "created_at", "category", "location", "level"):
        text, place, issues = (r["text"] or "").strip(), r["location"] or {}, []
        if len(text) < 15:
            issues.append("text_too_short" if text else "missing_text")
        issues += [f"missing_{c}" for c in ("source", "language", "category") if not (r[c] or "").strip()]
        if parsed(r["created_at"]) is None:
            issues.append("fallback_timestamp_used")
        issues += [f"missing_{c}" for c in ("province", "district") if not (place.get(c) or "").strip() and (c == "province" or r["level"] == "district")]
        out.append((r["_id"], ",".join(issues), not set(issues) - {"fallback_timestamp_used"}))
    return out


def location_tag() -> object:
    places = [((r["name"] if r["kind"] == "province" else r["province"]), "" if r["kind"] == "province" else r["name"]) for r in docs("places") if r["kind"] != "category"]
    names: dict = {}
    for p, d in sorted(places, key=lambda x: x[1] != ""):
        names.setdefault((d or p).replace("İ", "i").replace("I", "ı").lower(), (p, d))
    edge = "a-zA-ZğüşıöçĞÜŞİÖÇ"
    rx = [(re.compile(rf"(?<![{edge}]){re.escape(n)}(?![{edge}])"), at) for n, at in sorted(names.items(), key=lambda x: -len(x[0]))]

    def find(text: str) -> tuple[str, str]:
        t, province = text.replace("İ", "i").replace("I", "ı").lower(), ("", "")
        for r, at in rx:
            if r.search(t):
                if at[1]:
                    return at
                province = province if province[0] else at
        return province

    out = []
    for r in docs("posts_raw", "_id", "text", "post_tags"):
        got = next((at for x in r["post_tags"] or [] if x and (at := find(x))[0]), None)
        out.append((r["_id"], *(got or find(r["text"] or ""))))
    return out


def incremental_skip() -> object:
    known = {r["post_id"] for r in docs("posts_processed", "post_id")}
    return [(r["_id"], "known" if r["_id"] in known else "new") for r in docs("posts_raw", "_id")]


def topk_topics_per_request() -> object:
    rows = docs("posts_raw", "_id", "source", "topic_url", "page")
    done, rank = {r["topic_url"] for r in rows if r["page"] == 5}, {}
    for r in rows:
        k = (r["source"], r["topic_url"])
        rank[k] = min(rank.get(k, r["_id"]), r["_id"])
    by: dict = defaultdict(list)
    for (s, u), n in rank.items():
        if u is None or u not in done:
            by[s].append((n, u))
    return {s: sorted(x, key=lambda v: v[0])[:10] for s, x in by.items()}


def upsert_merge() -> object:
    out: dict = {}
    rows = docs("posts_raw", "post_id", "_id", "source", "page")
    for old in (True, False):
        for r in sorted((r for r in rows if (r["page"] == 1) is old), key=lambda r: r["_id"]):
            out[r["post_id"]] = r
    return out


def classification_metrics() -> object:
    n = Counter((r["sentiment"]["llm"]["label"], r["sentiment"]["transformer"]["label"]) for r in docs("posts_processed", "sentiment"))
    return n["positive", "positive"], n["negative", "negative"], n["negative", "positive"], n["positive", "negative"]


QUERIES = (
    province_sentiment, map_two_grain, map_category_breakdown, geo_metadata, clean_text, text_fingerprint_dedupe, parse_dates, validate_records, location_tag,
    incremental_skip, topk_topics_per_request, upsert_merge, classification_metrics,
)


def main() -> None:
    took = {}
    for q in QUERIES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            q()
            runs.append(time.perf_counter() - began)
            if runs[-1] > 20:
                break
        took[q.__name__] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
