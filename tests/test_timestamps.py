import itertools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from yakamoz.operators import timestamps as ts

SCHEMA = "_id bigint, created_at string, source string, collected_at timestamp_ntz, zone string"
PROFILES = [("ist", "Europe/Istanbul", "DMY"), ("ny", "America/New_York", "MDY"), ("ldn", "Europe/London", "DMY"), ("open", "UTC", None)]


def micros(y, m, d, h=0, mi=0, s=0, us=0, zone="UTC"):
    at = datetime(y, m, d, h, mi, s, us, tzinfo=ZoneInfo(zone))
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("2020-01-02T03:04:05.123456789Z", "ist", micros(2020, 1, 2, 3, 4, 5, 123456)),
    ("20200102T030405Z", "ist", micros(2020, 1, 2, 3, 4, 5)),
    (" 2020-01-02t03:04:05z ", "ist", micros(2020, 1, 2, 3, 4, 5)),
    ("1.2.20 3:04", "ist", micros(2020, 2, 1, 3, 4, zone="Europe/Istanbul")),
    ("01.02.2020 ÖS 12:10", "ist", micros(2020, 2, 1, 12, 10, zone="Europe/Istanbul")),
    ("01.02.2020 ÖÖ 12:10", "ist", micros(2020, 2, 1, 0, 10, zone="Europe/Istanbul")),
    ("01.02.2020 10:00 ~ 02.02.2020 11:00", "ist", micros(2020, 2, 1, 10, zone="Europe/Istanbul")),
    ("01.02.2020 10:00 tarihinde", "ist", micros(2020, 2, 1, 10, zone="Europe/Istanbul")),
    ("9 Kasım 2020 Pazartesi, 01:48", "ist", micros(2020, 11, 9, 1, 48, zone="Europe/Istanbul")),
    ("18 ARALIK 2019", "ist", micros(2019, 12, 18, zone="Europe/Istanbul")),
    ("Fri, 01 Dec 2023 12:19:51 +0300", "ny", micros(2023, 12, 1, 9, 19, 51)),
    ("01 Apr 2017 22:52:43 GMT", "ny", micros(2017, 4, 1, 22, 52, 43)),
    ("2018-03-12 20:37:29 America/New_York", "ist", micros(2018, 3, 12, 20, 37, 29, zone="America/New_York")),
    ("2019-08-28T04:27:03[America/New_York]", "ist", micros(2019, 8, 28, 4, 27, 3, zone="America/New_York")),
    ("05.02.2017 08:48 (UTC-0330)", "ist", micros(2017, 2, 5, 12, 18)),
    ("2025-09-23 12:07:45 CEST", "ist", micros(2025, 9, 23, 10, 7, 45)),
    ("2025-09-23 12:07:45 TRT", "ny", micros(2025, 9, 23, 9, 7, 45)),
    ("2025-07-23 12:07:45 BST", "ny", micros(2025, 7, 23, 11, 7, 45)),
    ("04/05/2020 3:15 PM", "ny", micros(2020, 4, 5, 15, 15, zone="America/New_York")),
    ("04/05/2020 13:15", "ist", micros(2020, 5, 4, 13, 15, zone="Europe/Istanbul")),
    ("1602957852", "ist", 1602957852 * 10**6), ("1637221690299", "ist", 1637221690299 * 1000),
    ("13/25/2020 10:00", "ist", None), ("31.02.2020 10:00", "ist", None), ("25:61", "ist", None), ("dün 14:30", "ist", None), ("", "ist", None),
    (None, "ist", None), ("   ", "ist", None), ("tarihinde", "ist", None), ("2020-13-05 10:00:00", "ist", None), ("00.00.0000 00:00", "ist", None),
    ("29.03.2020 01:30", "ldn", None), ("25.10.2020 01:30", "ldn", None), ("2020-01-02T03:04:05Z", "ist", None), ("x" * 20_000, "ist", None),
    ("2020-01-02 03:04:05", "unknown", micros(2020, 1, 2, 3, 4, 5)), ("2020-01-02 03:04:05", None, micros(2020, 1, 2, 3, 4, 5)),
]


def rows(spark, values):
    data = [(i, v, s, datetime(2026, 1, 1) + timedelta(hours=i), "clash") for i, (v, s, _) in enumerate(values)]
    return spark.createDataFrame(data, SCHEMA)


def test_notations(spark):
    prof = spark.createDataFrame(PROFILES, "source string, zone string, date_order string")
    got = {r.raw_id: r.utc_micros for r in ts.unambiguous_instants(rows(spark, CASES), prof).collect()}
    assert got == {i: m for i, (_, _, m) in enumerate(CASES) if m is not None}


def test_every_row_comes_out_once(spark):
    prof = spark.createDataFrame(PROFILES, "source string, zone string, date_order string")
    df = rows(spark, CASES)
    got = ts.normalise_timestamps(df.unionByName(df), prof).collect()
    assert len(got) == 2 * len(CASES)
    assert {r.n_interpretations for r in got if r.raw_id == 33} == {2} or any(r.n_interpretations == 2 for r in got)
    assert all(r.utc_micros is not None for r in got if r.n_interpretations)


def test_empty(spark):
    prof = spark.createDataFrame(PROFILES, "source string, zone string, date_order string")
    assert ts.normalise_timestamps(rows(spark, []), prof).count() == 0


def test_order_decides_undeclared_days(spark):
    """With no declared order, neighbours that can only be read one way decide."""
    prof = spark.createDataFrame(PROFILES, "source string, zone string, date_order string")
    values = [(f"{d:02d}/03/2020 10:00", "open", None) for d in (1, 2, 3, 13, 14, 20)]
    got = {r.raw_id: r.utc_micros for r in ts.normalise_timestamps(rows(spark, values), prof).collect()}
    assert [got[i] for i in range(6)] == [micros(2020, 3, d, 10) for d in (1, 2, 3, 13, 14, 20)]


@pytest.mark.parametrize("seed", range(6))
def test_stretches_equal_one_pass(spark, seed):
    """The chained stretches cost what the best of all ways through the whole source costs."""
    rng = np.random.default_rng(seed)
    run = []
    for _ in range(9):
        k = int(rng.choice([1, 2, 2]))
        run.append((rng.integers(0, 50, k).tolist(), [str(x) for x in rng.integers(0, 2, k)], rng.choice([0.0, 4.0], k).tolist()))

    def cost(way):
        picked = [([r[0][i]], [r[1][i]], [r[2][i]]) for r, i in zip(run, way)]
        return picked[0][2][0] + sum(float(ts._step(a, b)[0, 0]) for a, b in zip(picked, picked[1:]))

    best = min(cost(w) for w in itertools.product(*[range(len(r[0])) for r in run]))
    import json

    import pandas as pd

    parts, at = [], 0
    for n in (2, 3, 4):
        own = run[at : at + n]
        c, choice = ts._solve(own)
        parts.append((own, choice, json.dumps([list(own[0]), list(own[-1]), c.tolist()])))
        at += n
    picked = ts._chain(pd.DataFrame({"stretch": range(3), "source": "s", "summary": [p[2] for p in parts]}))
    way = []
    for (own, choice, _), pos in zip(parts, picked["pos"]):
        i, j = divmod(int(pos), len(own[-1][0]))
        way += choice[i, j].tolist()
    assert cost(way) == pytest.approx(best)


def test_hidden_notation_is_recovered(spark):
    """Known instants of a source whose zone repeats hours and whose day order nobody declares: the order of collection tells."""
    rng = np.random.default_rng(7)
    start = datetime(2023, 10, 20, tzinfo=timezone.utc)
    truth, data, at = {}, [], start
    zone = ZoneInfo("America/New_York")
    for i in range(4000):
        at += timedelta(minutes=float(rng.exponential(12)))
        shown = at.replace(second=0, microsecond=0)
        text = shown.astimezone(zone).strftime("%d/%m/%Y %H:%M")
        truth[i] = (shown - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        data.append((i, text, "ny", (at + timedelta(minutes=1)).replace(tzinfo=None), "clash"))
    prof = spark.createDataFrame([("ny", "America/New_York", None)], "source string, zone string, date_order string")
    got = ts.normalise_timestamps(spark.createDataFrame(data, SCHEMA).repartition(5), prof).collect()
    open_ = [r for r in got if r.n_interpretations > 1]
    right = sum(r.utc_micros == truth[r.raw_id] for r in open_) / len(open_)
    assert len(open_) > 1000 and right > 0.97, right
    assert all(r.utc_micros == truth[r.raw_id] for r in got if r.n_interpretations == 1)
