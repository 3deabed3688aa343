"""Search results and pages from the web, asked for by the tasks. How a request travels is the caller's: a function of the address.

Keys are configuration: they come from the environment or a file and are never part of a table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tries of a page, and seconds that the pause after the n-th failed one has for each n, twice.
TRIES, PAUSE = 3, 2.5
# Answers that another key or a later try may change; an answer that says there is no page.
KEY_REFUSED, AGAIN, ABSENT = frozenset({400, 401, 403, 429}), frozenset({403, 429}), 404

#: Address -> (status, text); OSError where nothing came.
Get = Callable[[str], tuple[int, str]]
#: Query, number of results, key -> (status, links).
Ask = Callable[[str, int, str], tuple[int, list[str]]]


def keys_of(environment: str | None, text: str | None = None) -> list[str]:
    """Keys in an environment value, else in a file's text: parted by blanks, line breaks or commas, each once."""
    return list(dict.fromkeys(k for k in re.split(r"[\s,]+", environment or text or "") if k))


def page(get: Get, url: str, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The page, or None if there is none: absent, or refused at every try. Other errors raise."""
    for n in range(1, tries + 1):
        try:
            status, text = get(url)
        except OSError:
            status, text = 0, ""
        if status == ABSENT:
            return None
        if 0 < status < 400:
            return text
        if status and status not in AGAIN and status < 500:
            raise RuntimeError(f"{url}: {status}")
        if n < tries:
            sleep(pause * n * 2)
    return None


def links(ask: Ask, query: str, n: int, keys: list[str], site: str) -> list[str]:
    """Links of the site that a search gives, in its order, each once. A key that is refused gives way to the next one; with all
    refused, or another error, RuntimeError."""
    for key in keys:
        try:
            status, found = ask(query, n, key)
        except OSError:
            continue
        if status in KEY_REFUSED:
            continue
        if status >= 400:
            raise RuntimeError(f"search: {status}")
        return list(dict.fromkeys(x for x in found if site in x))
    raise RuntimeError("no key of the search works")


@dataclass
class Web:
    """A page source: searches and downloads run in the tasks, a row at a time, ``delay`` seconds apart."""

    get: Get
    ask: Ask
    keys: list[str]
    site: str
    delay: float = 0.4
    results: int = 10
    sleep: Callable[[float], None] = field(default=time.sleep)

    def search(self, queries: DataFrame) -> DataFrame:
        one = self

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for query, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows += [(query, i, x) for i, x in enumerate(links(one.ask, query, n or one.results, one.keys, one.site))]
                    one.sleep(one.delay)
                q, i, x = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(i, pa.int32()), pa.array(x, pa.string())], ["query", "rank", "link"])

        return queries.select("query", "num_results").mapInArrow(run, "query string, rank int, link string")

    def pages(self, urls: DataFrame) -> DataFrame:
        one = self

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                html = []
                for url in b.column(0).to_pylist():
                    html.append(page(one.get, url, sleep=one.sleep))
                    one.sleep(one.delay)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(html, pa.string())], ["url", "html"])

        return urls.select("url").mapInArrow(run, "url string, html string")
