import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def normal(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)

    def one(x):
        if isinstance(x, float):
            return round(x, 9)
        if hasattr(x, "isoformat"):
            return x.isoformat()
        return int(x) if hasattr(x, "__int__") and not isinstance(x, (str, bool)) else x

    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_task_expansion_of_other_places(spark, tmp_path):
    """Requests name places that this table hasn't, or has in another province only: they give no rows and stop none of the others."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE places AS SELECT * FROM (VALUES (1, 'category', NULL, 'kafe'), (2, 'category', NULL, 'park'), (3, 'province', NULL, 'Öteil'), (4, 'province', NULL, 'Dırdümlı'),
      (5, 'district', 'Öteil', 'Tıksurlı'), (6, 'district', 'Öteil', 'Çay'), (7, 'district', 'Dırdümlı', 'Çay')) t(place_id, kind, province, name)""")
    con.execute(f"COPY places TO '{tmp_path}/places.parquet'")
    got, want = entry.queries()["task_expansion"](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()["task_expansion"]).df()
    assert normal(got) == normal(want)
    assert got.groupby("request_id").size().to_dict() == {"r1": 2, "r2": 6, "r3": 2, "r4": 4, "r7": 1, "r8": 2}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {n for n in entry.queries() if n[0] == "p" and n[1:2].isdigit() and not n.startswith("p1_")}))
def test_runs(spark, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)
    if name == "p1_found":
        assert dict(got.dtypes) == {"raw_id": "bigint", "utc_micros": "bigint"} and all(r.raw_id is not None and r.utc_micros is not None for r in rows)
    if name == "p1_instants":
        posts = spark.read.parquet(f"{SF}/posts_raw.parquet")
        assert len(rows) == posts.count() and all((r.utc_micros is None) == (r.n_interpretations == 0) for r in rows)


def test_every_query_has_sql_or_a_test_of_its_own():
    left = set(entry.queries()) - set(entry.oracle_sql())
    assert all(n[0] == "p" and n[1:2].isdigit() for n in left)


def test_training_data_library_missing(tmp_path):
    """Without one of its libraries the queries for training data are left out; the others stay."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('blocked')")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'province_sentiment' in q and not any(n.startswith('p2_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"}, cwd=root)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
