"""Mixed timestamp notations, precisions and zones -> one UTC instant per record.

Every value is read in all ways that are valid for it (day/month order where the source declares none, both offsets of a
repeated wall time). One reading per record is then chosen by a Viterbi pass over each source's records in the order in
which they were collected; switching the notation, jumping back in time and lying after the collection time cost.

Distribution. Records are range-partitioned by (source, collection time, id) as they are read, then interpreted, so a source that holds half of all records is
spread over as many tasks as its size asks for. A task solves its stretch for every pair of readings of its first and last
record (readings per record are few: at most four) and emits, for the records that depend on them, the choice for each
pair. One row per stretch and source, at most tasks + sources rows, is then chained in (min, +) algebra and the chosen pair
is joined back. That is exact: the result equals one sequential pass over the whole source.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakamoz.runtime import at_most, cut

#: Source profiles that may be broadcast; choices of end readings, one for each stretch and source, that may be.
MAX_PROFILES, MAX_STRETCHES = 10_000, 2_000_000

# Month names, Turkish and English, diacritics folded.
MONTHS = (
    "ocak subat mart nisan mayis haziran temmuz agustos eylul ekim kasim aralik",
    "oca sub mar nis may haz tem agu eyl eki kas ara",
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
)
# Weekday names, Turkish and English, diacritics folded.
WEEKDAYS = (
    "pazartesi sali carsamba persembe cuma cumartesi pazar pzt sal car per cum cmt paz "
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun"
).split()
# Minutes east of UTC of zone abbreviations (European and US meanings).
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "trt": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Micros.
SECOND, DAY = 1_000_000, 86_400_000_000
#: Costs of the Viterbi pass.
SWITCH, BACK, AFTER_COLLECTION = 1.0, 1.5, 4.0

_MONTH_NO = {name: i + 1 for row in MONTHS for i, name in enumerate(row.split())}
_MONTH = "|".join(sorted(_MONTH_NO, key=len, reverse=True))
_WDAY = "|".join(sorted(WEEKDAYS, key=len, reverse=True))
_DATES = {
    "iso": r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:t|,? |$)(.*)$",
    "dot": r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?:,? |$)(.*)$",
    "slash": r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:,? |$)(.*)$",
    "word": rf"^(?:(?:{_WDAY}),? )?(\d{{1,2}}) ({_MONTH})\.? (\d{{4}})(?:,? (?:{_WDAY}))?(?:,? |$)(.*)$",
    "us_word": rf"^(?:(?:{_WDAY}),? )?({_MONTH})\.? (\d{{1,2}}),? (\d{{4}})(?:,? |$)(.*)$",
}
_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})t(\d{2}):?(\d{2})(?::?(\d{2}))?([.,]\d+)?(z|[+-]\d{2}(?::?\d{2})?)?$"
_TIME = (
    r"^(?:(oo|os|am|pm) )?(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?(?: ?(oo|os|am|pm)(?![a-z]))?"
    r"(?: ?(\(.*\)|\[.*\]|[+-]\d{2}(?::?\d{2})?|[a-z]+(?:/[a-z_+\-0-9]+)*))?$"
)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _lookup(of: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key)


def _zoned(wall: Column, zone: Column) -> Column:
    """array<bigint>: the instants whose wall time in ``zone`` is ``wall``; none in a gap, two in a fold."""
    at = lambda m, shift: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(m + shift), zone)) - shift
    both = F.array_distinct(F.array(at(wall, -DAY), at(wall, DAY)))
    return F.filter(both, lambda u: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), zone)) == wall)


def interpretations(df: DataFrame, value: str, source: str, zone: str, date_order: str) -> DataFrame:
    """``df`` with ``_notes``, array<string> of notation names, and ``_instants``, array<bigint> of UTC micros: all valid
    readings of ``value``. ``zone`` and ``date_order`` are columns with the source's home zone and DMY or MDY, null if not
    known: then UTC wall time and both orders are read. Null, blank, relative and impossible values have no reading."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.col(value), r"(?U)\s+", " "), r"~.*$", ""))
    text = F.translate(F.lower(F.regexp_replace(raw, r" ?tarihinde$", "")), "ığüşöç̇", "igusoc")
    df = df.withColumns({"_raw": raw, "_t": F.regexp_replace(text, _COMPACT, "$1-$2-$3t$4:$5:0$6$7$8")})
    # a compact value without seconds got ':0', one with seconds ':0SS'
    df = df.withColumn("_t", F.regexp_replace("_t", r"^(\d{4}-\d{2}-\d{2}t\d{2}:\d{2}):0(\d{2})(?!\d)", "$1:$2"))
    df = df.withColumn("_t", F.regexp_replace("_t", r"^(\d{4}-\d{2}-\d{2}t\d{2}:\d{2}):0(?=$|[.,z+-])", "$1:00"))
    t = F.col("_t")
    kind = F.when(t.rlike(r"^\d+$"), "number")
    for name, rx in _DATES.items():
        kind = kind.when(t.rlike(rx), name)
    df = df.withColumn("_kind", kind)
    k, part = F.col("_kind"), {}
    for i, order in enumerate(
        ({"iso": 1, "dot": 3, "slash": 3, "word": 3, "us_word": 3}, {"iso": 2, "dot": 2, "slash": 2, "word": 2, "us_word": 1},
         {"iso": 3, "dot": 1, "slash": 1, "word": 1, "us_word": 2}, dict.fromkeys(_DATES, 4))
    ):
        c = F.lit(None).cast("string")
        for name, rx in _DATES.items():
            c = F.when(k == name, F.regexp_extract(t, rx, order[name])).otherwise(c)
        part[i] = c
    df = df.withColumns({"_y": part[0], "_m": part[1], "_d": part[2], "_rest": part[3]})
    rest, parts = F.col("_rest"), ("half1", "h", "mi", "s", "frac", "half2", "zone")
    df = df.withColumns({f"_{n}_": F.regexp_extract(rest, _TIME, g) for g, n in enumerate(parts, 1)} | {"_ok": rest.rlike(_TIME)})
    got, ok = {n: F.col(f"_{n}_") for n in parts}, F.col("_ok")
    half = F.concat(got["half1"], got["half2"])
    hour = _int(F.when(got["h"] == "", "0").otherwise(got["h"]))
    hour = (
        F.when(half == "", F.when(hour <= 23, hour))
        .when(~half.isin("oo", "os", "am", "pm") | ~hour.between(1, 12), None)
        .otherwise(hour % 12 + F.when(half.isin("os", "pm"), 12).otherwise(0))
    )
    minute, sec = (_int(F.when(got[x] == "", "0").otherwise(got[x])) for x in ("mi", "s"))
    frac = F.rpad(F.substring(got["frac"], 1, 6), 6, "0").cast("long")
    clock = F.when(
        ok & (minute <= 59) & (sec <= 59), ((hour * 60 + minute) * 60 + sec).cast("long") * SECOND + frac
    )
    z = F.regexp_replace(got["zone"], r"[\[\]() ]", "")
    region = F.regexp_extract(F.col("_raw"), r"([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)[\])]?$", 1)
    off = F.regexp_extract(z, r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$", 0) != ""
    minutes = F.when(
        off,
        (_int(F.regexp_extract(z, r"([+-])(\d{1,2}):?(\d{2})?$", 2)) * 60
         + F.coalesce(_int(F.nullif(F.regexp_extract(z, r"([+-])(\d{1,2}):?(\d{2})?$", 3), F.lit(""))), F.lit(0)))
        * F.when(z.contains("-"), -1).otherwise(1),
    ).otherwise(_lookup(ABBREVIATIONS, z))
    regions = sorted(x for x in available_timezones() if "/" in x)
    df = df.withColumns({
        "_clock": clock, "_z": z, "_minutes": minutes,
        "_region": F.when(region.isin(regions), region),
        "_month": F.coalesce(_int(F.col("_m")), _lookup(_MONTH_NO, F.col("_m"))),
        "_year": _int(F.col("_y")) + F.when(F.length("_y") == 2, 2000).otherwise(0), "_day": _int(F.col("_d")),
    })

    def wall(y: Column, m: Column, d: Column) -> Column:
        longest = F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31).when(
            ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)
        good = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= longest)
        days = F.unix_date(F.make_date(F.when(good, y), F.when(good, m), F.when(good, d)))
        return days.cast("long") * DAY + F.col("_clock")

    y, m, d = F.col("_year"), F.col("_month"), F.col("_day")
    order = F.upper(F.trim(F.col(date_order)))
    df = df.withColumns({
        "_w1": F.when((k != "slash") | F.coalesce(order == "DMY", ~F.coalesce(order == "MDY", F.lit(False))), wall(y, m, d)),
        "_w2": F.when((k == "slash") & F.coalesce(order != "DMY", F.lit(True)), wall(y, d, m)),
    })
    df = df.withColumn("_home", F.when(F.col(zone).isin(sorted(available_timezones())), F.col(zone)).otherwise("UTC"))
    home = F.col("_home")
    none = F.array().cast("array<bigint>")

    def instants(w: Column) -> Column:
        zoned = F.when(F.col("_z") == "", _zoned(w, home)).when(F.col("_region").isNotNull(), _zoned(w, F.col("_region")))
        fixed = F.when(F.col("_minutes").isNotNull(), F.array(w - F.col("_minutes").cast("long") * 60 * SECOND))
        return F.when(w.isNull(), none).otherwise(F.coalesce(zoned, fixed, none))

    n = F.length(t)
    number = t.try_cast("decimal(20,0)")
    counted = (
        F.when(n <= 11, number * SECOND).when(n <= 14, number * 1000).when(n <= 17, number)
        .when(n <= 20, F.floor(number / 1000))
    ).try_cast("bigint")
    note = F.concat_ws(
        ":", k, F.when(F.col("_z") == "", "local").when(F.col("_region").isNotNull(), "region").otherwise("offset"),
        F.length(got["frac"]).cast("string"), F.when(half != "", "12h"),
    )
    df = df.withColumns({"_i1": instants(F.col("_w1")), "_i2": instants(F.col("_w2")), "_note": note})
    is_no = k == "number"
    df = df.withColumns({
        "_instants": F.when(is_no & counted.isNotNull(), F.array(counted)).when(
            k.isNull() | is_no, none).otherwise(F.concat("_i1", "_i2")),
        "_notes": F.when(is_no & counted.isNotNull(), F.array(F.concat(F.lit("number:"), n.cast("string")))).when(
            k.isNull() | is_no, F.array().cast("array<string>")).otherwise(F.concat(
                F.transform("_i1", lambda _: F.concat(F.col("_note"), F.lit(":1"))),
                F.transform("_i2", lambda _: F.concat(F.col("_note"), F.lit(":2"))))),
    })
    return df.drop("_raw", "_t", "_kind", "_y", "_m", "_d", "_rest", "_clock", "_z", "_minutes", "_region", "_month", "_year",
                   "_day", "_w1", "_w2", "_i1", "_i2", "_note", "_home", "_ok", *(f"_{n}_" for n in parts))


def _step(a: tuple, b: tuple) -> np.ndarray:
    """Costs of going from each reading of record a to each of b; a record is (instants, notes, cost of each reading)."""
    back = (np.asarray(b[0])[None, :] < np.asarray(a[0])[:, None]) * BACK
    switch = np.array([[SWITCH * (x != y) for y in b[1]] for x in a[1]])
    return back + switch + np.asarray(b[2])[None, :]


def _solve(run: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Best cost from each reading of the run's first record to each of its last, and the choices on that way:
    choices[i, j] has an index for each record. The first record's own cost isn't counted."""
    first = len(run[0][0])
    cost = np.where(np.eye(first, dtype=bool), 0.0, np.inf)
    back: list[np.ndarray] = []
    for a, b in zip(run, run[1:]):
        way = cost[:, :, None] + _step(a, b)[None, :, :]
        back.append(way.argmin(axis=1))
        cost = way.min(axis=1)
    last = len(run[-1][0])
    choices = np.zeros((first, last, len(run)), dtype=np.int64)
    for i in range(first):
        for j in range(last):
            at = j
            choices[i, j, -1] = at
            for step in range(len(back) - 1, -1, -1):
                at = back[step][i, at]
                choices[i, j, step] = at
    return cost, choices


_RESOLVED = pa.schema([
    ("id", pa.int64()), ("plain", pa.bool_()), ("n", pa.int32()), ("options", pa.list_(pa.int64())), ("stretch", pa.int32()),
    ("source", pa.string()), ("summary", pa.string()),
])
_RESOLVED_DDL = "id bigint, plain boolean, n int, options array<bigint>, stretch int, source string, summary string"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range partition, sorted: a row for each record with its instant, or one for each pair of readings of the
    stretch's first and last record, and a summary row for each source."""
    part = TaskContext.get().partitionId()
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    source = t["source"].to_pandas().to_numpy(dtype=object)
    lens = t["instants"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lens)])
    micros = t["instants"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    notes = t["notes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    late = t["collected"].combine_chunks().to_numpy(zero_copy_only=False)

    def record(i: int) -> tuple:
        own = slice(starts[i], starts[i + 1])
        after = micros[own] > late[i] if not np.isnan(late[i]) else np.zeros(lens[i], dtype=bool)
        return micros[own], notes[own], after * AFTER_COLLECTION

    options: list = [None] * len(lens)
    single = np.flatnonzero(lens == 1)
    for i, v in zip(single.tolist(), micros[starts[single]].tolist()):
        options[i] = [v]
    edges = np.flatnonzero(source[1:] != source[:-1]) + 1
    summaries = []
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(lens)]):
        chain = lo + np.flatnonzero(lens[lo:hi] > 0)
        if not len(chain):
            continue
        sure = lens[chain] == 1
        cuts = np.unique(np.concatenate([[0, len(chain) - 1], np.flatnonzero(sure)]))
        first, last = record(chain[0]), record(chain[-1])
        pairs = np.column_stack([cuts[:-1], cuts[1:]]) if len(cuts) > 1 else np.array([[0, 0]])
        # between two neighbouring sure records there is nothing to choose and the cost is a constant
        open_ = (pairs[:, 1] - pairs[:, 0] > 1) | ~sure[pairs[:, 0]] | ~sure[pairs[:, 1]]
        cost = None
        for a, b in pairs[open_].tolist():
            run = [chain[x] for x in range(a, b + 1)]
            c, choice = _solve([record(x) for x in run])
            cost = c if cost is None else (cost[:, :, None] + c[None]).min(axis=1)
            whole = (len(first[0]) if a == 0 else 1, len(last[0]) if b == len(chain) - 1 else 1)
            for p, x in enumerate(run):
                if lens[x] > 1:  # readings of the first record by those of the last, row by row
                    grid = np.broadcast_to(micros[starts[x] + choice[:, :, p]], whole)
                    options[x] = np.broadcast_to(grid, (len(first[0]), len(last[0]))).reshape(-1).tolist()
        if cost is None:
            cost = np.zeros((len(first[0]), len(last[0])))
        ends = [[r[0].tolist(), list(r[1]), r[2].tolist()] for r in (first, last)]
        summaries.append((source[lo], json.dumps([*ends, cost.tolist()])))
    n, k = len(lens), len(summaries)
    yield pa.RecordBatch.from_arrays([
        t["id"].combine_chunks(), t["plain"].combine_chunks(), pa.array(lens.astype(np.int32)), pa.array(options, pa.list_(pa.int64())),
        pa.array([part] * n, pa.int32()), pa.array(source, pa.string()), pa.nulls(n, pa.string())], schema=_RESOLVED)
    yield pa.RecordBatch.from_arrays([
        pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())),
        pa.array([part] * k, pa.int32()), pa.array([s for s, _ in summaries], pa.string()),
        pa.array([s for _, s in summaries], pa.string())], schema=_RESOLVED)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Choose each stretch's pair of end readings; pdf has one row for each stretch of one source."""
    pdf = pdf.sort_values("stretch")
    parts = [json.loads(s) for s in pdf["summary"]]
    run: list[tuple] = []
    for first, last, _ in parts:
        run += [tuple(first), tuple(last)]
    cost = np.asarray(run[0][2], dtype=float)
    back = []
    for i, (first, last, inner) in enumerate(parts):
        if i:
            way = cost[:, None] + _step(run[2 * i - 1], run[2 * i])
            back.append(way.argmin(axis=0))
            cost = way.min(axis=0)
        way = cost[:, None] + np.asarray(inner)
        back.append(way.argmin(axis=0))
        cost = way.min(axis=0)
    at, picks = int(cost.argmin()), []
    for b in reversed(back):
        picks.append(at)
        at = int(b[at])
    picks = [*picks, at][::-1]
    pos = [picks[2 * i] * len(p[1][0]) + picks[2 * i + 1] for i, p in enumerate(parts)]
    return pd.DataFrame({"stretch": pdf["stretch"].to_numpy(), "source": pdf["source"].to_numpy(), "pos": pos})


def normalise_timestamps(
    df: DataFrame, profiles: DataFrame, *, key: str = "_id", value: str = "created_at", source: str = "source", collected: str = "collected_at"
) -> DataFrame:
    """(``raw_id`` bigint, ``already_plain`` boolean, ``n_interpretations`` int, ``utc_micros`` bigint), one row for each row of ``df``.

    ``profiles`` (source, zone, date_order) is broadcast: one row per source, checked to be at most MAX_PROFILES. utc_micros is the
    chosen reading, null where there is none (null, blank, relative or impossible values; n_interpretations 0).
    n_interpretations above 1 marks values that were ambiguous by themselves: repeated wall times, or undeclared day order.
    Repeated rows and rows with equal times stay as they are, ordered by key; a null source is a source of its own; an empty
    table gives an empty result; further columns are ignored.
    """
    prof = profiles.select(F.col("source").alias("_src"), F.col("zone").alias("_zone"), F.col("date_order").alias("_order"))
    prof = at_most(prof.dropDuplicates(["_src"]), MAX_PROFILES, "source profiles")
    x = df.select(
        F.col(key).cast("bigint").alias("id"), F.col(value).alias("_value"), F.coalesce(F.col(value).rlike(_PLAIN), F.lit(False)).alias("plain"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.unix_micros(F.col(collected).cast("timestamp_ntz").cast("timestamp")).cast("double").alias("collected"),
    )
    # the values as they are go through the shuffle: its sample and its map side read no interpretation
    x = x.repartitionByRange("source", "collected", "id")
    x = x.join(F.broadcast(prof), F.col("source") == F.col("_src"), "left")
    x = interpretations(x, "_value", "source", "_zone", "_order")
    x = x.select("id", "plain", "source", "collected", F.col("_instants").alias("instants"), F.col("_notes").alias("notes"))
    # sorted here: the optimizer drops a sort that a join stands above
    solved = cut(x.sortWithinPartitions("source", "collected", "id").mapInArrow(_stretches, _RESOLVED_DDL))
    picked = solved.where("summary IS NOT NULL").groupBy("source").applyInPandas(_chain, "stretch int, source string, pos int")
    few = solved.where("summary IS NOT NULL").limit(MAX_STRETCHES + 1).count() <= MAX_STRETCHES
    rows = solved.where("summary IS NULL").join(F.broadcast(picked) if few else picked, ["stretch", "source"], "left")
    return rows.select(
        F.col("id").alias("raw_id"), F.col("plain").alias("already_plain"), F.col("n").alias("n_interpretations"),
        F.when(F.size("options") == 1, F.col("options")[0]).otherwise(F.get("options", F.col("pos"))).alias("utc_micros"),
    )


def unambiguous_instants(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(``raw_id``, ``utc_micros``): the rows whose value names exactly one instant and isn't written as YYYY-MM-DDTHH:MM:SSZ."""
    return normalise_timestamps(df, profiles).where("n_interpretations = 1 AND NOT already_plain").select("raw_id", "utc_micros")
