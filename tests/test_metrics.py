import random

from pyspark.sql import functions as F

from lumenspan.operators import metrics
from lumenspan.plans import ordered
from lumenspan.plans.ranks import at_ranks, nearest_ranks

S = 10**9


def _series(spark, *points, service="svc"):
    rows = [(service, "{}", int(t), float(v)) for t, v in points]
    return spark.createDataFrame(rows, "service_name string, attributes string, time_unix_nano bigint, value double")


def _values(df):
    return [r["value"] for r in df.orderBy("service_name", "time_unix_nano").collect()]


def test_series_and_catalog(make_points):
    points = make_points(
        *[
            {"name": "http.requests", "time_unix_nano": t, "value": t, "attributes": {"route": route}}
            for t in range(4)
            for route in ("/a", "/b")
        ]
    )
    series = metrics.series_points(metrics.metric_series(points, "http.requests")).collect()
    assert [len(r["points"]) for r in series] == [4, 4]
    assert metrics.list_metrics(points).count() == 1
    assert metrics.metric_series(points, "http.requests", time_min=1, time_max=2).count() == 4
    spaced = points.withColumn("attributes", F.lit('{"b": 1, "a": 2}'))
    key = metrics.metric_series(spaced, "http.requests", canonical_attributes=True).first()["attributes"]
    assert key == '{"a":2,"b":1}'


def test_steps_of_a_counter_that_restarts_twice(spark):
    """A turnstile: 7 people in 2 s, restart at 3, 5 more in 5 s, restart at nothing, 9 in 3 s."""
    counter = _series(spark, (10 * S, 40), (12 * S, 47), (13 * S, 3), (18 * S, 8), (20 * S, 0), (23 * S, 9))
    for bounded in (True, False):
        assert _values(metrics.rate(counter, bounded)) == [3.5, 3.0, 1.0, 0.0, 3.0]
        assert _values(metrics.increase(counter, bounded)) == [7.0, 0.0, 5.0, 0.0, 9.0]
    assert metrics.rate(counter.limit(1)).count() == 0
    assert metrics.aggregate_series(counter, "median of medians") is counter


def test_points_of_equal_time(spark):
    # Ordered by value: 1, 5 | 3, 9 | 10
    series = _series(spark, (0, 5), (0, 1), (S, 9), (S, 3), (2 * S, 10))
    assert _values(metrics.increase(series)) == [0.0, 1.0]


def test_series_are_averaged_in_slots_and_then_folded(spark):
    """Two tanks over [0, 900]: three slots of 300, the south tank silent in the middle one."""
    north = _series(spark, (0, 3), (100, 5), (350, 8), (400, 10), (900, 1), service="north")
    south = _series(spark, (50, 20), (899, 6), service="south")
    both = north.unionByName(south)
    folded = {f: metrics.aggregate_series(both, f, 3).orderBy("time_unix_nano").collect() for f in ("sum", "avg", "min", "max")}
    assert {f: [r["value"] for r in rows] for f, rows in folded.items()} == {
        "sum": [24.0, 9.0, 7.0], "avg": [12.0, 9.0, 3.5], "min": [4.0, 9.0, 1.0], "max": [20.0, 9.0, 6.0],
    }
    assert {(r["service_name"], r["attributes"]) for r in folded["min"]} == {("min", '{"aggregation":"min","series":2}')}
    assert [r["time_unix_nano"] for r in folded["avg"]] == [150, 450, 750]
    assert metrics.aggregate_series(both.filter("value > 99"), "max").count() == 0
    broken = both.unionByName(_series(spark, (450, float("nan")), service="west"))
    assert _values(metrics.aggregate_series(broken, "max", 3)) == [20.0, 9.0, 6.0]


def test_stats(spark):
    row = metrics.series_stats(_series(spark, (5, 2), (1, 8), (9, 5))).first()
    assert (row["points"], row["first_value"], row["last_value"]) == (3, 8.0, 5.0)
    assert (row["min_value"], row["max_value"], row["avg_value"], row["latest_unix_nano"]) == (2.0, 8.0, 5.0, 9)


def test_exemplars_of_a_trace_or_span(make_points):
    """Points of two pumps; the second carries exemplars of two traces, one of them twice."""
    points = make_points(
        {"name": "pump.one", "exemplars": [("c0ffee", "0a", 5, 0.5)]},
        {"name": "pump.two", "exemplars": [("c0ffee", "0b", 7, 1.5), ("decade", "0a", 6, 2.5), ("c0ffee", "0c", 9, 3.5)]},
        {"name": "pump.idle"},
    )
    found = lambda *a, **k: sorted(r["value"] for r in metrics.find_exemplars(points, *a, **k).collect())
    assert found("C0FFEE") == found("c0ffee", n=0) == found("c0ffee", n=None) == [0.5, 1.5, 3.5]
    assert found("c0ffee", "0B") == [1.5] and found("decade", "0a") == [2.5] and found("decade", "0b") == []
    assert len(found("c0ffee", n=2)) == 2
    assert found("beef") == found("") == found("000") == []


def _brute_steps(points):
    points = sorted(points)
    out = []
    for (t0, v0), (t1, v1) in zip(points, points[1:]):
        if t1 > t0:
            out.append((t1, (v1 if v1 < v0 else v1 - v0) / ((t1 - t0) / 1e9)))
    return out


def test_sliced_windows_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(ordered, "SLICES", 7)
    monkeypatch.setattr(ordered, "BLOCK", 3)
    data = {}
    for service in ("hot", "cold", "single"):
        n = {"hot": 900, "cold": 40, "single": 1}[service]
        # Bunched times with ties and gaps, and exact copies.
        data[service] = [(rng.choice([0, 5, 5, 900]) * S + rng.randint(0, 60) * S, float(rng.randint(0, 9))) for _ in range(n)]
    df = None
    for service, points in data.items():
        part = _series(spark, *points, service=service)
        df = part if df is None else df.unionByName(part)
    got = {}
    for r in metrics.rate(df).collect():
        got.setdefault(r["service_name"], []).append((r["time_unix_nano"], r["value"]))
    for service, points in data.items():
        assert sorted(got.get(service, [])) == _brute_steps(points)

    kept = {}
    for r in metrics.downsample(df, 100).collect():
        kept.setdefault(r["service_name"], []).append((r["time_unix_nano"], r["value"]))
    for service, points in data.items():
        stride = -(-len(points) // 100)
        assert sorted(kept[service]) == sorted(points)[::stride]


def test_metric_query_counts_series_emptied_by_rate(make_points):
    points = make_points(
        *[{"time_unix_nano": i * S, "value": i * 2, "attributes": {"i": 1}} for i in range(5)],
        {"time_unix_nano": 0, "attributes": {"i": 2}},
    )
    rows = metrics.metric_query(points, "m", "rate", "sum").collect()
    assert {r["value"] for r in rows} == {2.0} and rows[0]["attributes"] == '{"aggregation":"sum","series":2}'


def test_exact_ranks_on_skewed_groups(spark):
    rng = random.Random(11)
    groups = {
        "copies": [7] * 500,
        "spread": [rng.randint(0, 10**12) for _ in range(700)],
        "dense": [10**9 + rng.randint(0, 1000) for _ in range(900)],
        "small": [1, 2, 3, 4],
        "zero": [0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v bigint")
    probabilities = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = {r["g"]: r for r in nearest_ranks(df, ["g"], "v", probabilities).collect()}
    for g, values in groups.items():
        ordered_values = sorted(values)
        for name, p in probabilities.items():
            index = int((len(values) - 1) * p + 0.5)
            assert found[g][name] == ordered_values[index], (g, name)
    assert found["small"]["p50"] == 3
    whole = at_ranks(df, [], "v", {"low": lambda n: F.lit(0), "high": lambda n: n - 1}).first()
    assert (whole["low"], whole["high"]) == (0, max(v for _, v in rows))
