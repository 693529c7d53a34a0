import json
import random

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import records as R
from lumenspan.operators import fields, logs


def test_newest_severe_and_matching_logs(make_logs):
    """A day of a ferry terminal: every seventh record is a warning, every eleventh an error."""
    severities = [13 if i % 7 == 0 else 17 if i % 11 == 0 else 5 for i in range(1, 78)]
    df = make_logs(
        *[
            {"time_unix_nano": i, "severity_number": n, "body": f"berth {i % 4} " + ("Delayed" if n > 9 else "clear"), "attributes": {"ship": {"id": i % 5}}}
            for i, n in enumerate(severities, 1)
        ]
    )
    errors = [i for i, n in enumerate(severities, 1) if n == 17]
    assert [r["time_unix_nano"] for r in logs.query_logs(df, min_severity=17).collect()] == errors[::-1]
    assert [r["time_unix_nano"] for r in logs.query_logs(df, 3).collect()] == [77, 76, 75]
    assert logs.query_logs(df, None, search="dELAYed").count() == sum(n > 9 for n in severities)
    third = R.logs.field_is("ship.id", "3") & ~R.logs.field_is("level", "debug")
    assert logs.search_logs(df, third).count() == sum(n > 9 and i % 5 == 3 for i, n in enumerate(severities, 1))
    assert logs.histogram_totals(logs.log_histogram(df, 4, third)).first()["total"] == logs.search_logs(df, third).count()
    fields_of = {r["name"]: r["count"] for r in logs.log_fields(df).collect()}
    assert fields_of["ship.id"] == fields_of["level"] == 77 and "scope" not in fields_of


def _bars(rows):
    return [(r["time_unix_nano"], r["debug"], r["error"]) for r in rows.collect()]


def test_histogram_spans_the_data_or_the_window(make_logs):
    """Debug records at 100, 110, ..., 190 and errors at 100 and 190."""
    df = make_logs(
        *[{"time_unix_nano": 100 + 10 * i, "severity_number": 6} for i in range(10)],
        *[{"time_unix_nano": t, "severity_number": 20} for t in (100, 190)],
    )
    data = _bars(logs.log_histogram(df, 3))
    assert len(data) == 3 and data[0][0] == 100 and sum(b for _, b, _ in data) == 10 and [e for *_, e in data] == [1, 0, 1]
    window = _bars(logs.log_histogram(df, 4, time_min=120, time_max=160))
    assert (window[0][0], sum(b for _, b, _ in window), sum(e for *_, e in window)) == (120, 5, 0)
    moment = logs.log_histogram(df.filter("time_unix_nano = 190"), 4)
    assert [(b, e) for _, b, e in _bars(moment)] == [(1, 1), (0, 0), (0, 0), (0, 0)]
    for nothing in (df.limit(0), df.filter("severity_number > 24")):
        assert logs.log_histogram(nothing, 4).count() == 0
    assert logs.log_histogram(df, 4, time_min=500, time_max=600).count() == 0
    with pytest.raises(ValueError):
        logs.log_histogram(df, -1)


def test_histogram_of_many_rows_and_numbers_without_a_level(spark, make_logs):
    """Row i has time 7 i and severity i mod 26: those of 0 and 25 have no level of their own and count as info."""
    rows = spark.range(5200).select((F.col("id") * 7).alias("time_unix_nano"), (F.col("id") % 26).cast("int").alias("severity_number"))
    df = make_logs({}).limit(0).unionByName(rows, allowMissingColumns=True)
    bars = logs.log_histogram(df, 5200, time_min=0, time_max=7 * 5200).collect()
    assert len(bars) == 5200 and {sum(r[level] for level in ("trace", "debug", "info", "warn", "error", "fatal")) for r in bars} == {1}
    few = logs.log_histogram(df, 9)
    assert list(few.agg(*(F.sum(c) for c in ("trace", "debug", "info", "warn", "error", "fatal"))).first()) == [800, 800, 1200, 800, 800, 800]
    assert logs.histogram_totals(few).first()["total"] == 5200


@pytest.mark.parametrize(("characters", "want"), [(None, [("pine" * 20 + "é", 1), ("pine" * 20 + "ü", 1)]), (80, [("pine" * 20, 2)]), (4, [("pine", 2)])])
def test_whole_values_are_counted_unless_cut(spark, characters, want):
    seen = spark.createDataFrame([("tree", "pine" * 20 + end) for end in "éü"], "name string, value string")
    row = fields.rank_fields(seen, characters=characters).first()
    assert [(v["value"], v["count"]) for v in row["top_values"]] == want


def test_rank_fields(spark):
    seen = [("a", v) for v in "xxyyzw"] + [("a", str(i)) for i in range(5)] + [("b", "1")] * 11 + [("", "no")]
    rows = fields.rank_fields(spark.createDataFrame(seen, "name string, value string")).collect()
    assert [(r["name"], r["count"]) for r in rows] == [("a", 11), ("b", 11)]
    assert [(v["value"], v["count"]) for v in rows[0]["top_values"]] == [("x", 2), ("y", 2), ("0", 1), ("1", 1), ("2", 1)]
    assert fields.rank_fields(spark.createDataFrame(seen, "name string, value string"), 1).count() == 1


def test_flatten_json(make_logs):
    df = make_logs(
        {
            "attributes": {
                "a": {"b": {"c": {"d": 1}}, "e": []},
                "empty": {},
                "flag": True,
                "gone": None,
                "half": 2.5,
                "list": [1, {"x": 2}],
                "look": '{"like":"object"}',
            }
        }
    )
    found = dict(map(tuple, fields.flatten_json(df, "attributes").collect()))
    assert found == {
        "a.b.c.d": "1",
        "a.e": "[]",
        "flag": "true",
        "gone": "null",
        "half": "2.5",
        "list": '[1,{"x":2}]',
        "look": '{"like":"object"}',
    }


def _walk(value, prefix=""):
    for name, member in value.items():
        if isinstance(member, dict):
            yield from _walk(member, f"{prefix}{name}.")
        else:
            yield prefix + name, member if isinstance(member, str) else json.dumps(member, separators=(",", ":"))


def test_objects_of_any_depth_are_opened(spark):
    rng = random.Random(8)
    leaf = [1, 1.5, "x{", '{"no":1}', None, True, [1, {"z": 2}]]

    def make(depth):
        return {rng.choice(["a", "b", "c.d", "e"]): rng.choice(leaf) if depth == 0 or rng.random() < 0.4 else make(depth - 1) for _ in range(rng.randrange(4))}

    chain = {"leaf": 1}
    for level in range(25):
        chain = {f"k{level}": chain}
    documents = [make(rng.choice([0, 1, 2, 9])) for _ in range(200)] + [chain]
    df = spark.createDataFrame([(i, json.dumps(d, separators=(",", ":"))) for i, d in enumerate(documents)] + [(-1, None)], "i int, d string")
    found = sorted(map(tuple, fields.flatten_json(df, "d", ["i"]).collect()))
    assert found == sorted((i, n, v) for i, d in enumerate(documents) for n, v in _walk(d))


def test_fields_of_chosen_traces(make_spans):
    """Three traces of a lighthouse, a buoy and both; each span names its lamp, buoys their chain, too."""
    lamp = lambda n: {"attributes": {"lamp": {"watts": n}}, "resource_attributes": {"sea": "north"}}
    chain = {"attributes": {"lamp": {"watts": 5}, "chain.m": 40}}
    spans = make_spans(
        ("far", "1", "", "lighthouse", 10, 20, lamp(1000)), ("far", "2", "1", "lighthouse", 11, 12, lamp(1000)),
        ("near", "3", "", "buoy", 30, 31, chain),
        ("both", "4", "", "lighthouse", 50, 60, lamp(800)), ("both", "5", "4", "buoy", 51, 52, chain),
    )
    counts = lambda **how: {r["name"]: r["count"] for r in fields.trace_fields(spans, **how).collect()}
    assert counts() == {"lamp.watts": 5, "sea": 3, "chain.m": 2}
    assert counts(service="buoy") == {"lamp.watts": 3, "chain.m": 2, "sea": 1}
    assert counts(sample_traces=1) == {"lamp.watts": 2, "chain.m": 1, "sea": 1}
    (top, *_), = (r["top_values"] for r in fields.trace_fields(spans, 1).collect())
    assert (top["value"], top["count"]) in {("1000", 2), ("5", 2)}
