import random
import zipfile

import pytest

from lumenspan.functions import records as R
from lumenspan.operators import metrics
from lumenspan.registry import exchange
from lumenspan.schema import LOGS, SPANS
from lumenspan.session import settings
from lumenspan.streaming import live

S = 10**9


def _files(df, folder, parts):
    """Write rows as several files in the given order, one per list of row numbers."""
    rows = df.collect()
    for part in parts:
        df.sparkSession.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, tmp_path, spark):
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


SERIES = "service_name string, attributes string, time_unix_nano bigint, value double"


def _text_rows(rows):
    return sorted(tuple(str(v) for v in row) for row in rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_rate_of_late_and_split_points_equals_batch(spark, tmp_path, parts):
    """Points out of order, moments split over batches, resets, missing and NaN values."""
    rng = random.Random(parts)
    odd = [None, float("nan")]
    points = [
        (name, "{}", t * S + 7, rng.choice(odd) if rng.random() < 0.1 else float(rng.randrange(40)))
        for name in ("a", "b", "long silence") for t in rng.choices(range(1000, 1200), k=90 if name != "long silence" else 4)
    ]
    points.sort(key=lambda p: p[2] + rng.random() * 50 * S)
    df = spark.createDataFrame(points, SERIES)
    folder, step = str(tmp_path / "in"), -(-len(points) // parts)
    _files(df, folder, [range(k, min(k + step, len(points))) for k in range(0, len(points), step)])
    # A far point moves the watermark past everything else.
    spark.createDataFrame([("end", "{}", 9_000 * S, 0.0)], df.schema).coalesce(1).write.mode("append").parquet(folder)
    got = _run(live.live_rate(_stream(spark, folder, df.schema), "60 seconds"), tmp_path, spark)
    assert _text_rows(got) == _text_rows(metrics.rate(df).select(*metrics.SERIES, metrics.TIME, "value").collect())


def test_rate_of_a_restarted_stream_and_beyond_its_delay(spark, tmp_path):
    points = [("a", "{}", t * S, float(v)) for t, v in [(100, 1), (101, 4), (102, 9), (200, 2), (300, 5), (103, 50)]]
    df = spark.createDataFrame(points, SERIES)
    folder = str(tmp_path / "in")
    for part in ([0, 1, 2], [3], [4], [5]):
        _files(df, folder, [part])
        got = _run(live.live_rate(_stream(spark, folder, df.schema), "10 seconds"), tmp_path, spark)
    # The point of second 103 came when the watermark was at 290; that of second 300 waits for a later one.
    assert sorted((r.time_unix_nano // S, r.value) for r in got) == [(101, 3.0), (102, 5.0), (200, 2 / 98)]


def test_rate_of_an_ended_stream_has_the_newest_points(spark, tmp_path):
    points = [("a", "{}", t * S, float(v)) for t, v in [(100, 1), (101, 4), (200, 2), (300, 5)]] + [("b", "{}", 300 * S, 1.0)]
    df = spark.createDataFrame(points, SERIES)
    _files(df, str(tmp_path / "in"), [[0, 1], [2], [3, 4]])
    ends = live.Ending(spark, str(tmp_path / "ends"))
    rates = live.live_rate(ends.after(_stream(spark, str(tmp_path / "in"), df.schema)), "1 hour")
    assert _run(rates, tmp_path, spark) == []
    ends.close()
    assert _text_rows(_run(rates, tmp_path, spark)) == _text_rows(metrics.rate(df).select(*metrics.SERIES, metrics.TIME, "value").collect())


def test_rate_forgets_silent_series(spark, tmp_path):
    points = [("a", "{}", t * S, float(t)) for t in (100, 110, 400, 410, 900)] + [("b", "{}", t * S, float(t)) for t in (100, 150, 200, 250, 300, 350, 400)]
    df = spark.createDataFrame(sorted(points, key=lambda p: p[2]), SERIES)
    folder = str(tmp_path / "in")
    _files(df, folder, [[k] for k in range(len(points))])
    got = _run(live.live_rate(_stream(spark, folder, df.schema), "1 second", ttl_seconds=120), tmp_path, spark)
    assert sorted((r.service_name, r.time_unix_nano // S) for r in got) == [("a", 110), ("a", 410), *(("b", t) for t in (150, 200, 250, 300, 350, 400))]


def test_sessions_close_after_the_gap(spark, tmp_path, make_spans):
    spans = make_spans(
        ("t1", "a", "", "front", 0, 5 * S),
        ("t1", "b", "a", "back", 2 * S, 4 * S, {"status_code": 2}),
        ("t2", "c", "", "front", 40 * S, 41 * S),
        ("far", "z", "", "front", 10_000 * S, 10_001 * S),
    )
    spans.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = _run(live.session_traces(_stream(spark, str(tmp_path / "in"), SPANS), "30 seconds", "10 seconds"), tmp_path, spark)
    found = {r["trace_id"]: r for r in rows}
    assert set(found) == {"t1", "t2"}
    assert (found["t1"]["span_count"], found["t1"]["error_count"], found["t1"]["root_name"]) == (2, 1, "op-a")
    assert found["t1"]["services"] == ["back", "front"]


def test_sessions_are_sorted_and_written_without_reads(spark, tmp_path, make_spans, capsys):
    """Late and split spans over several batches give the sessions of the table; the end closes them all."""
    rng = random.Random(8)
    rows = [
        (f"t{rng.randrange(6)}", f"s{k}", rng.choice(["", "p"]), rng.choice("abc"), t * S + k, (t + rng.randrange(9)) * S, {"status_code": rng.randrange(3)})
        for k, t in enumerate(rng.choices(range(1000, 3000), k=150))
    ]
    spans, far = make_spans(*rows), make_spans(("far", "z", "", "c", 90_000 * S, 90_000 * S))
    folder, key = str(tmp_path / "in"), "spark.sql.execution.useObjectHashAggregateExec"
    _files(spans, folder, [range(k, k + 30) for k in range(0, 150, 30)])
    far.coalesce(1).write.mode("append").parquet(folder)
    closed, before = live.session_traces(_stream(spark, folder, SPANS), "30 seconds", "1 hour"), spark.conf.get(key)
    with settings(spark, live.SESSIONS_CONF):
        query = (
            closed.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
    assert spark.conf.get(key) == before
    query.awaitTermination()
    got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out"))
    assert got.count() > 50 and _text_rows(got.collect()) == _text_rows(live.session_traces(spans, "30 seconds").collect())
    stores = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress]
    assert sum(s["rocksdbPutCount"] for s in stores) > 0 and sum(s["rocksdbGetCount"] for s in stores) == 0
    query.explain()
    plan = capsys.readouterr().out
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan


def test_the_query_of_sessions_starts_under_their_settings(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(exchange, "settings", lambda session, conf: seen.append(conf) or settings(session, conf))
    key, price = "spark.sql.execution.useObjectHashAggregateExec", "100.0D"
    orders = f"SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, {price} AS o_totalprice, timestamp_ntz'2000-01-01' + make_dt_interval(CAST(id * 100 AS INT)) AS o_orderdate, 'HIGH' AS o_orderpriority FROM range(3)"
    lines = "SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 2.0D AS l_quantity, 1.0D AS l_extendedprice, 0.0D AS l_discount, 0.0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, timestamp_ntz'2000-01-02' + make_dt_interval(CAST(id * 100 AS INT)) AS l_shipdate FROM range(3)"
    for name, sql in (("orders", orders), ("lineitem", lines)):
        spark.sql(sql).toPandas().to_parquet(str(tmp_path / f"{name}.parquet"), coerce_timestamps="us")
    before = spark.conf.get(key)
    found = {r["trace_id"]: (r["span_count"], r["services"]) for r in exchange.session_traces(spark, str(tmp_path)).collect()}
    assert found == {"0": (2, "HIGH,NO"), "1": (2, "HIGH,NO")}
    assert seen == [live.SESSIONS_CONF] and spark.conf.get(key) == before


def test_open_sessions_are_kept_compressed(spark, tmp_path, make_spans):
    """The options stored with the state name the compression its files were written with."""
    folder = str(tmp_path / "in")
    make_spans(("t", "a", "", "s", S, S)).coalesce(1).write.parquet(folder)
    with settings(spark, live.SESSIONS_CONF):
        _run(live.session_traces(_stream(spark, folder, SPANS), "30 seconds", "1 hour"), tmp_path, spark)
    states = list((tmp_path / "checkpoint" / "state").rglob("*.zip"))
    options = [z.read(n).decode() for z in map(zipfile.ZipFile, states) for n in z.namelist() if "OPTIONS" in n]
    assert options and all("compression=kZSTD" in text for text in options)


def test_duplicates_across_batches(spark, tmp_path, make_spans):
    spans = make_spans(("t", "a", "", "s", S, S), ("t", "b", "", "s", 2 * S, 2 * S))
    folder = str(tmp_path / "in")
    _files(spans, folder, [[0, 1], [1], [0, 1]])
    assert len(_run(live.deduplicated(_stream(spark, folder, SPANS)), tmp_path, spark)) == 2


def test_volume_and_tail(spark, tmp_path, make_logs):
    logs = make_logs(
        *[{"time_unix_nano": i * 20 * S, "severity_number": 17 if i % 3 == 0 else 9, "body": f"n{i}"} for i in range(9)],
        {"time_unix_nano": 10_000 * S},
    )
    logs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = _stream(spark, str(tmp_path / "in"), LOGS)
    rows = _run(live.live_volume(stream, "1 minute", "1 minute"), tmp_path, spark)
    assert sorted((r["time_unix_nano"], r["error"], r["info"]) for r in rows) == [(i * 60 * S, 1, 2) for i in range(3)]
    tail = _run(live.live_tail(stream, R.logs.field_is("level", "error")), tmp_path / "tail", spark)
    assert sorted(r["body"] for r in tail) == ["n0", "n3", "n6"]


def test_live_red(spark, tmp_path, make_spans):
    spans = make_spans(
        ("t", "a", "", "s", 0, 4_000_000), ("t", "b", "a", "s", 30 * S, 30 * S + 8_000_000, {"status_code": 2}),
        ("f", "z", "", "s", 10_000 * S, 10_000 * S),
    )
    spans.coalesce(1).write.parquet(str(tmp_path / "in"))
    red = live.live_red(_stream(spark, str(tmp_path / "in"), SPANS), "1 minute", "1 minute")
    (row,) = _run(red, tmp_path, spark)
    assert (row["span_count"], row["error_count"], row["error_rate"], row["p99_ms"]) == (2, 1, 0.5, 8.0)
