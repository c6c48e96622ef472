"""Each stream drained over files, against the same rule on the whole table."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaline.streaming import streams as S


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Events in time order, in four files."""
    path = tmp_path_factory.mktemp("events")
    rows = pd.read_parquet(f"{sf}/events.parquet").sort_values("ts", kind="stable")
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    step = -(-len(rows) // 4)
    for k in range(4):
        rows[k * step : (k + 1) * step].to_parquet(path / f"{k}.parquet", index=False)
    return str(path), rows


def test_one_file_is_a_stream(spark, sf):
    stream = S.routed(S.events(spark, f"{sf}/events.parquet"), [("high", F.col("value") > 300), ("click", F.col("event_type") == "click")])
    got = {r.route: r.n for r in S.drained(stream, "t_one_file").groupBy("route").agg(F.count("*").alias("n")).collect()}
    rows = pd.read_parquet(f"{sf}/events.parquet")
    high = rows["value"] > 300
    click = ~high & (rows["event_type"] == "click")
    assert got == {"high": high.sum(), "click": click.sum(), "default": len(rows) - high.sum() - click.sum()}


def test_windows_close_by_the_watermark(spark, folder):
    path, rows = folder
    got = {(r.start, r.event_type): (r.n, r["mean"]) for r in S.drained(S.windowed(S.events(spark, path), "1 day"), "t_windows").collect()}
    want = {}
    for (day, kind), part in rows.groupby([rows["ts"].dt.floor("D"), "event_type"]):
        if day + dt.timedelta(days=1) <= rows["ts"].max() - dt.timedelta(minutes=10):
            want[day.to_pydatetime(), kind] = (len(part), part["value"].mean())
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


def test_debounced_as_one_pass_over_each_key(spark, folder):
    path, rows = folder
    got = sorted((r.user_id, r.ts) for r in S.drained(S.debounced(S.events(spark, path), "user_id", 86400), "t_debounced").collect())
    want = []
    for user, part in rows.groupby("user_id"):
        last = None
        for t in part["ts"]:
            if last is None or t - last >= dt.timedelta(days=1):
                last = t
                want.append((user, t.to_pydatetime()))
    assert 0 < len(want) < len(rows)
    assert got == sorted(want)


def test_repeats_within_the_watermark_go(spark, folder, tmp_path):
    _, rows = folder
    pd.concat([rows, rows[:50]]).to_parquet(tmp_path / "twice.parquet", index=False)
    got = S.drained(S.deduplicated(S.events(spark, str(tmp_path)), ["event_id"], "40 days"), "t_repeats")
    assert got.count() == got.select("event_id").distinct().count() == len(rows)


def test_a_failing_stream_raises(spark, sf):
    with pytest.raises(Exception, match="(?i)divi|cast|user"):
        S.drained(S.events(spark, f"{sf}/events.parquet").withColumn("x", F.raise_error(F.lit("user error"))), "t_fails")
