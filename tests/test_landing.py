"""Versioned tables and landings: whole versions, repeated batches, failed writes; crisis scores by hand."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators import crisis
from tidewell.operators.merge import merge_prefer_incoming
from tidewell.sources.versioned import VersionedTable, summary
from tidewell.streaming.landing import Landing
from tidewell.streaming.streams import shared_folder

D = dt.date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, D + dt.timedelta(days=i), v) for k, i, v in rows], "k int, t date, v double")


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def rows(df):
    return sorted((r.k, (r.t - D).days, r.v) for r in df.collect())


def test_versions_replace_and_keep(spark, folder):
    table = VersionedTable(spark, folder, "k int, t date, v double", "k")
    assert table.read().collect() == [] and table.manifest()["version"] == 0
    assert table.replace(frame(spark, [(1, 0, 1.0), (2, 0, 2.0)])) and table.replace(frame(spark, [(1, 0, 9.0)]))
    # Nothing to write keeps what there is.
    assert not table.replace(frame(spark, []))
    assert rows(table.read()) == [(1, 0, 9.0)] and rows(table.read(1)) == [(1, 0, 1.0), (2, 0, 2.0)]
    assert table.vacuum(1) == 1 and rows(table.read()) == [(1, 0, 9.0)]


def test_upserts_touch_their_parts_alone_and_no_batch_twice(spark, folder):
    table = VersionedTable(spark, folder, "k int, t date, v double", "date_format(t, 'yyyy-MM')")
    table.upsert(frame(spark, [(1, 0, 1.0), (1, 40, 4.0)]), merge_prefer_incoming, 0)
    before = table.manifest()
    assert table.upsert(frame(spark, [(1, 40, 5.0), (1, 41, None), (2, 41, 7.0)]), merge_prefer_incoming, 1)
    after = table.manifest()
    assert after["parts"]["2024-01"] == before["parts"]["2024-01"] and after["parts"]["2024-02"] != before["parts"]["2024-02"]
    want = [(1, 0, 1.0), (1, 40, 5.0), (1, 41, None), (2, 41, 7.0)]
    assert sorted(map(str, rows(table.read()))) == sorted(map(str, want))
    assert not table.upsert(frame(spark, [(1, 0, 100.0)]), merge_prefer_incoming, 1) and table.manifest() == after
    assert {r.k: r.n for r in summary(table).collect()} == {1: 3, 2: 1}


def test_a_failed_write_leaves_the_old_version(spark, folder):
    table = VersionedTable(spark, folder, "k int, t date, v double", "k")
    table.replace(frame(spark, [(1, 0, 1.0)]))
    broken = frame(spark, [(1, 0, 2.0)]).withColumn("v", F.expr("CAST(raise_error('lost') AS DOUBLE)"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, merge_prefer_incoming, 5)
    assert rows(table.read()) == [(1, 0, 1.0)] and table.manifest()["batch"] == -1
    # What the failed writes left is swept up; the version stays.
    table.vacuum()
    assert rows(table.read()) == [(1, 0, 1.0)]


def test_parts_of_any_text(spark, folder):
    df = spark.createDataFrame([("a/b=c d", D, 1.0), ("ü%2F", D, 2.0), ("a/b=c d", D + dt.timedelta(days=1), 3.0)], "k string, t date, v double")
    table = VersionedTable(spark, folder, "k string, t date, v double", "k")
    table.replace(df)
    assert set(table.manifest()["parts"]) == {"a/b=c d", "ü%2F"} and table.read(parts=["ü%2F"]).count() == 1 and table.read().count() == 3


def test_landings_refuse_and_repeat(spark, folder):
    landing = Landing(spark, folder, "int", "date_format(t, 'yyyy-MM')", tail_days=10)
    batch = lambda x: frame(spark, x).withColumn("seq", F.monotonically_increasing_id())
    assert landing.land(batch([(1, 0, 10.0), (1, 30, 12.0), (1, 30, 13.0)]).coalesce(1), 0)
    second = [(1, 5, 11.0), (1, 25, 12.5), (1, 30, 40.0), (1, 31, -1.0), (1, 32, float("nan")), (2, 0, 5.0)]
    assert landing.land(batch(second), 1)
    now, refused = rows(landing.table.read()), sorted((r.batch, (r.t - D).days, r.reason) for r in landing.quarantined().collect())
    assert now == [(1, 0, 10.0), (1, 25, 12.5), (1, 30, 13.0), (2, 0, 5.0)]
    assert refused == [(1, 5, "settled"), (1, 30, "jump"), (1, 31, "invalid"), (1, 32, "invalid")]
    # The same batch again, as after a failure behind its commit.
    assert not landing.land(batch(second), 1)
    assert rows(landing.table.read()) == now and sorted((r.batch, (r.t - D).days, r.reason) for r in landing.quarantined().collect()) == refused


def readings(spark, days, **values):
    out = []
    for name, v in values.items():
        out += [(0, name, D + dt.timedelta(days=i), float(v(i) if callable(v) else v)) for i in range(days)]
    return spark.createDataFrame(out, "k int, name string, t date, v double")


def test_uninversion_alone_stays_below_warning(spark):
    got = crisis.crisis_scores(readings(spark, 220, curve2y=lambda i: -0.5 if i < 120 else 1.2, curve3m=lambda i: -0.4 if i < 120 else 1.3, spread=1.2, sahm=0.0)).orderBy("t").collect()
    assert got[119].curve == 20 and got[0].curve == 16 and not got[119].uninversion
    assert all(r.uninversion and r.score == r.curve <= 49 and r.stage == "caution" for r in got[120:])
    # The day of un-inversion: 24, full speed, and nothing worn off.
    assert got[120].curve == 40


def test_labour_and_credit_confirm_a_crisis(spark):
    got = crisis.crisis_scores(readings(spark, 220, curve2y=lambda i: -0.5 if i < 120 else 1.2, curve3m=lambda i: -0.4 if i < 120 else 1.3, spread=lambda i: 1.0 if i < 150 else 4.5, sahm=lambda i: 0.0 if i < 150 else 0.8, claims=lambda i: 200 if i < 150 else 300)).orderBy("t").collect()
    assert got[200].stage == "crisis" and (got[200].labor, got[200].credit) == (30, 30) and got[149].stage == "caution"


def test_reports_follow_the_last_report(spark):
    days = [0, 3, 6, 7, 8, 9, 15, 16, 17]
    stages = "ssswwwwww"
    df = spark.createDataFrame([(0, D + dt.timedelta(days=d), s) for d, s in zip(days, stages, strict=True)], "k int, t date, stage string")
    # The first; a week after it, with a new stage; a week after that one; the last.
    assert sorted((r.t - D).days for r in crisis.reported(df).collect()) == [0, 7, 15, 17]
