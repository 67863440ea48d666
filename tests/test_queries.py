"""A sample of the registered queries against their SQL, and the contract of the entry module."""

import math
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = sorted(entry.oracle_sql())


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return int(x) if isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("sample tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, DIR)
    cols = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=repr)
    found = duck.execute(entry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(at) == cols
    assert mine == sorted((tuple(plain(r[at[c]]) for c in cols) for r in found.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_forest_and_solve_read_whole_tables(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    tree = {(r.cap, r.parent, r.child) for r in entry.queries()["spanning_forest"](spark, str(tmp_path)).collect()}
    assert {c // 400 for _, _, c in tree} == {0, 1, 2} and all(a // 400 == b // 400 and a % 10 == b % 10 for _, a, b in tree)
    spark.range(300).selectExpr("id as event_id", "id % 3 as user_id", "id as ts", "cast(id % 50 as double) as value").write.parquet(f"{tmp_path}/events.parquet")
    seqs = sorted((r.cap, r.seq) for r in entry.queries()["smooth_solve"](spark, str(tmp_path)).collect())
    assert seqs == [(c, k) for c in range(3) for k in range(100)]


def test_opening_gate_takes_opening_widths_only(spark):
    """Areas, heights, perimeters and walls are not worked out for the gate, and leaving them out changes no row."""
    from planloom.operators import evaluate as E
    from planloom.plans import plan_queries as Q

    if not os.path.isdir(DIR):
        pytest.skip("sample tables are not here")
    gate = entry.queries()["opening_gate"](spark, DIR)
    text = gate._jdf.queryExecution().optimizedPlan().toString()
    assert "/opening-" in text and not any(k in text for k in ("/floor_area", "/perimeter"))
    d, t = Q.dimensions(spark, DIR), Q.truth_table(spark, DIR)
    whole = E.opening_gate(E.evaluate_rows(d, t), d, t).select("cap", "successes", "truths", "phantoms", *Q._r("fraction"), "passes")
    assert sorted(map(tuple, gate.collect())) == sorted(map(tuple, whole.collect()))
