"""Conversation queries against their oracle SQL at the smallest size, and literal cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.operators import intervals, speech, transcript

SF = "/root/testdata/sf0.001"
TABLES = "customer orders events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(list(x)) if isinstance(x, (list, tuple)) else repr(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    sql = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == columns
    assert got == rows(tuple(r[names.index(c)] for c in columns) for r in sql.fetchall())


def test_gap_fill(spark):
    p = spark.createDataFrame([(1, "a", 16000, 32000)], "recording_id long, passage_id string, start_sample long, end_sample long")
    d = spark.createDataFrame([(1, 48000)], "recording_id long, duration long")
    assert rows(intervals.uncovered_rows(p, d).collect()) == rows([(1, "unassigned-1", 0, 16000), (1, "unassigned-2", 32000, 48000)])


def test_hysteresis_is_a_fold(spark):
    import random

    r, data = random.Random(3), []
    for k in range(20):
        for i in range(40):
            data.append((k, i * 512, i * 512 + 512, r.randrange(100), r.random() < 0.1))
    got = {(x[0], x[1]): x["speaking"] for x in speech.hysteresis(spark.createDataFrame(data, "recording_id long, start_sample long, end_sample long, p100 int, constant_block boolean")).collect()}
    state = {}
    for k, a, _, p, constant in data:
        if not constant:
            state[k] = True if p >= 50 else False if p < 35 else state.get(k, False)
        assert got[k, a] == (state.get(k, False) and not constant)


def test_timestamp_is_half_even(spark):
    got = spark.createDataFrame([(8,), (24,), (1_600_000_000,)], "s long")
    assert [r[0] for r in got.select(transcript.timestamp(F.col("s"))).collect()] == ["00:00:00,000", "00:00:00,002", "27:46:40,000"]
