import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import otlp
from lumenspan.operators import fields, logs, metrics, traces
from lumenspan.sinks import otlp_export, tables
from lumenspan.sinks.tables import append, append_all, expired_counts, keep_newest, retention_cutoff, sweep_expired
from lumenspan.sources import otlp_json, retention
from lumenspan.sources.tables import Telemetry, logs_from_table, read_table, read_tables, spans_from_table


def _read(spark, tmp_path, schema, *documents):
    path = tmp_path / "documents.json"
    path.write_text("\n".join(json.dumps(d) for d in documents))
    return spark.read.schema(schema).json(str(path))


def _attribute(key, **value):
    return {"key": key, "value": value}


def _metrics(*metrics):
    scopes = [{"scope": {}, "metrics": list(metrics)}]
    return {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": scopes}]}


def _spans(attributes, *spans, **scope):
    return {"resource": {"attributes": attributes}, "scopeSpans": [{"scope": scope, "spans": list(spans)}]}


def test_span_document(spark, tmp_path):
    tags = [
        _attribute("wind", doubleValue=7.0), _attribute("crew", stringValue="Ada \\ \"Bo\"\t"), _attribute("wind", doubleValue=8.5),
        _attribute("night", boolValue=True), _attribute("blob", bytesValue="3q0="), _attribute("unset"), _attribute("knots", intValue=-12),
        _attribute("route", arrayValue={"values": [{"stringValue": "kiel"}, {"kvlistValue": {"values": [_attribute("quay", intValue="4")]}}]}),
    ]
    sail = {
        "traceId": "FEED00000000000000000000000000A1", "spanId": "00000000000000B2", "parentSpanId": "00000000000000B1", "name": "cast off",
        "kind": 4, "startTimeUnixNano": "250", "endTimeUnixNano": 1250, "status": {"code": 1, "message": "clear"}, "attributes": tags,
        "events": [{"name": "horn", "timeUnixNano": "300", "attributes": [_attribute("blasts", intValue="3")]}, {}],
        "links": [{"traceId": "FE", "spanId": "0C", "attributes": [_attribute("why", stringValue="tow")]}],
    }
    late = {"traceId": "t", "spanId": "s", "startTimeUnixNano": "90", "endTimeUnixNano": "20", "kind": 77}
    document = {
        "resourceSpans": [
            _spans([_attribute("service.name", stringValue="pier")], sail, name="rope", version="0.3"),
            _spans([_attribute("service.name", boolValue=True)], late),
            {"scopeSpans": [{"spans": [late]}]},
        ]
    }
    rows = otlp_json.flatten_spans(_read(spark, tmp_path, otlp_json.SPAN_DOCUMENTS, document)).collect()
    first, *others = rows
    want = {
        "trace_id": "feed00000000000000000000000000a1", "span_id": "00000000000000b2", "parent_span_id": "00000000000000b1",
        "name": "cast off", "kind": "producer", "service_name": "pier", "start_time_unix_nano": 250, "end_time_unix_nano": 1250,
        "duration_nanos": 1000, "status_code": 1, "status_message": "clear", "scope_name": "rope", "scope_version": "0.3",
        "resource_attributes": '{"service.name":"pier"}',
    }
    assert {k: first[k] for k in want} == want
    pairs = json.loads(first["attributes"], object_pairs_hook=list)
    assert [k for k, _ in pairs] == ["blob", "crew", "knots", "night", "route", "unset", "wind"]
    assert dict(pairs) == {
        "blob": "dead", "crew": 'Ada \\ "Bo"\t', "knots": -12, "night": True, "route": ["kiel", [("quay", 4)]], "unset": None, "wind": 8.5,
    }
    assert [(e["name"], e["time_unix_nano"], e["attributes"]) for e in first["events"]] == [("horn", 300, '{"blasts":3}'), ("", 0, "{}")]
    assert [(x["trace_id"], x["span_id"], x["attributes"]) for x in first["links"]] == [("fe", "0c", '{"why":"tow"}')]
    assert [(r["service_name"], r["kind"], r["duration_nanos"], r["status_code"]) for r in others] == [("unknown_service", "unspecified", 0, 0)] * 2
    assert [r["resource_attributes"] for r in others] == ['{"service.name":true}', "{}"]


def test_log_document(spark, tmp_path):
    records = [
        {"observedTimeUnixNano": "5", "body": {"stringValue": "hi"}, "severityNumber": 9},
        {"timeUnixNano": "3", "observedTimeUnixNano": "5", "body": {"kvlistValue": {"values": [_attribute("a", intValue="1")]}}},
        {"timeUnixNano": "18446744073709551615"},
    ]
    document = {"resourceLogs": [{"scopeLogs": [{"scope": {"name": "x"}, "logRecords": records}]}]}
    rows = otlp_json.flatten_logs(_read(spark, tmp_path, otlp_json.LOG_DOCUMENTS, document)).collect()
    assert [r["time_unix_nano"] for r in rows] == [5, 3, -1]
    assert [r["body"] for r in rows] == ["hi", '{"a":1}', "null"]
    assert [r["body_json"] for r in rows] == ['"hi"', '{"a":1}', "null"]


@pytest.fixture
def harbour_metrics():
    """A metric of every type from a harbour: cranes, tides, containers, waves and berths."""
    crane = {"traceId": "FADE", "spanId": "0C", "timeUnixNano": "31", "asInt": "12"}
    unlinked = {"spanId": "0D", "timeUnixNano": "32", "asDouble": 8.25}
    return _metrics(
        {"name": "berths", "unit": "{berth}", "gauge": {"dataPoints": [{"timeUnixNano": "40", "asDouble": -2.5, "exemplars": [unlinked]}, {"timeUnixNano": "41"}]}},
        {"name": "containers", "sum": {"aggregationTemporality": 1, "dataPoints": [{"timeUnixNano": "40", "asInt": "77", "exemplars": [crane, unlinked]}]}},
        {
            "name": "crane.load", "unit": "t",
            "histogram": {"dataPoints": [{"timeUnixNano": "40", "count": "6", "sum": 81, "min": 2.5, "bucketCounts": ["1", "0", "5"], "explicitBounds": [5, 12.5], "exemplars": [crane]}]},
        },
        {"name": "waves", "exponentialHistogram": {"dataPoints": [{"timeUnixNano": "40", "count": "9", "sum": 3.75, "max": 1.25, "scale": -1}]}},
        {"name": "tide", "summary": {"dataPoints": [{"timeUnixNano": "40", "sum": 12.0, "quantileValues": [{"quantile": 0, "value": 1.5}, {"quantile": 1, "value": 4}]}]}},
        {"name": "no points yet", "gauge": {"dataPoints": []}},
    )


def test_harbour_metrics(spark, tmp_path, harbour_metrics):
    points = otlp_json.flatten_metrics(_read(spark, tmp_path, otlp_json.METRIC_DOCUMENTS, harbour_metrics))
    figures = lambda df: sorted((r["name"], r["metric_type"], r["time_unix_nano"], r["value"], r["count"]) for r in df.collect())
    assert figures(points) == [
        ("berths", "gauge", 40, -2.5, 0), ("berths", "gauge", 41, 0.0, 0), ("containers", "sum", 40, 77.0, 0),
        ("crane.load", "histogram", 40, 81.0, 6), ("tide", "summary", 40, 12.0, 0), ("waves", "exponential_histogram", 40, 3.75, 9),
    ]
    rows = {r["name"]: r for r in points.filter("time_unix_nano = 40").collect()}
    assert {n: json.loads(r["extra"]) for n, r in rows.items()} == {
        "berths": {},
        "containers": {"is_monotonic": False, "temporality": 1},
        "crane.load": {"bucket_counts": [1, 0, 5], "explicit_bounds": [5.0, 12.5], "max": None, "min": 2.5, "temporality": 0},
        "tide": {"quantiles": [{"quantile": 0.0, "value": 1.5}, {"quantile": 1.0, "value": 4.0}]},
        "waves": {"max": 1.25, "min": None, "scale": -1, "zero_count": 0},
    }
    # Exemplars without a trace are left out, ids are folded to lower case.
    linked = {n: [tuple(x) for x in r["exemplars"]] for n, r in rows.items()}
    assert linked.pop("containers") == linked.pop("crane.load") == [("fade", "0c", 31, 12.0)]
    assert not any(linked.values())
    # Exported and read again: exponential histograms are gauges then, and exemplars are gone.
    lines = otlp_export.export_metrics(points)
    again = otlp_json.flatten_metrics(otlp_json.parse_documents(lines, otlp_json.METRIC_DOCUMENTS))
    as_gauge = [(n, "gauge" if n == "waves" else kind, t, v, 0 if n == "waves" else c) for n, kind, t, v, c in figures(points)]
    assert figures(again) == as_gauge and again.filter(F.size("exemplars") > 0).count() == 0
    extras = {r["name"]: r["extra"] for r in again.filter("time_unix_nano = 40").collect()}
    assert all(extras[n] == rows[n]["extra"] for n in ("containers", "crane.load", "tide"))


def _any_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return [
            {"stringValue": rng.choice(['a"b', "{x", "é[", '"arrayValue":'])}, {"boolValue": rng.random() < 0.5}, {"intValue": str(rng.randrange(10**15))},
            {"doubleValue": rng.randrange(1000) / 8 + 0.0625}, {}, {"bytesValue": "Aas="},
        ][kind]
    if kind == 8:
        return {"arrayValue": {"values": [_any_value(rng, depth - 1) for _ in range(rng.randrange(4))]}}
    return {"kvlistValue": {"values": [{"key": rng.choice("abcd"), "value": _any_value(rng, depth - 1)} for _ in range(rng.randrange(4))]}}


def _plain(value):
    for kind, held in value.items():
        if kind == "arrayValue":
            return [_plain(x) for x in held["values"]]
        if kind == "kvlistValue":
            return {e["key"]: _plain(e["value"]) for e in held["values"]}
        return int(held) if kind == "intValue" else "01ab" if kind == "bytesValue" else held
    return None


def test_values_of_any_depth_both_ways(spark):
    rng = random.Random(12)
    chain = {"intValue": "7"}
    for level in range(40):
        chain = {"kvlistValue": {"values": [{"key": f"k{level}", "value": chain}, {"key": "z", "value": {"arrayValue": {"values": [{"boolValue": True}]}}}]}}
    given = [[{"key": f"a{i}", "value": _any_value(rng, rng.choice([0, 1, 3, 12]))} for i in range(rng.randrange(6))] for _ in range(150)]
    given[7].append({"key": "chain", "value": chain})
    bodies = [_any_value(rng, 9) for _ in given]
    record = lambda n: {"timeUnixNano": str(n + 1), "body": bodies[n], "attributes": given[n]}
    texts = [(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record(n)]}]}]}),) for n in range(len(given))]
    read = lambda lines: otlp_json.flatten_logs(otlp_json.parse_documents(lines, otlp_json.LOG_DOCUMENTS))
    logs = read(spark.createDataFrame(texts, "value string"))
    text = lambda value: json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows = lambda df: {r["time_unix_nano"]: (r["attributes"], r["body_json"]) for r in df.collect()}
    found = rows(logs)
    assert found == {n + 1: (text({e["key"]: _plain(e["value"]) for e in kv}), text(_plain(bodies[n]))) for n, kv in enumerate(given)}
    assert rows(read(otlp_export.export_logs(logs))) == found


def test_export_bounds_documents(spark, make_spans):
    rows = [("t", f"{i:04x}", "", "svc", i, i + 1, {"resource_attributes": {"r": i % 2}}) for i in range(30)]
    spans = make_spans(*rows, ("u", "ff", "", "svc", 1, 2)).coalesce(1)
    lines = otlp_export.export_spans(spans, records=10)
    sizes = [sum(len(s["spans"]) for r in json.loads(x["value"])["resourceSpans"] for s in r["scopeSpans"]) for x in lines.collect()]
    assert sum(sizes) == 31 and max(sizes) <= 10


def test_documents_of_a_trace_are_numbered(spark, make_spans):
    """Thirty spans in parts of twelve, cut by their order of start however the rows are spread."""
    rows = [("t", f"{i:04x}", "", "svc", i // 2, i + 1, {"resource_attributes": {"r": i % 2}}) for i in range(30)]
    spans = make_spans(*rows, ("u", "ff", "", "svc", 1, 2))
    seen = []
    for partitions, ids in ((1, ["t", "u", "absent"]), (9, spark.createDataFrame([("u",), ("t",), ("t",)], "trace_id string"))):
        docs = otlp_export.traces_as_docs(spans.repartition(partitions), ids, records=12).collect()
        found = {}
        for row in docs:
            held = [s["spanId"] for r in json.loads(row["value"])["resourceSpans"] for s in r["scopeSpans"][0]["spans"]]
            found[row["trace_id"], row["part"], row["parts"]] = sorted(held)
        seen.append(found)
    cut = [[f"{i:04x}" for i in range(30)][k : k + 12] for k in (0, 12, 24)]
    assert seen[0] == seen[1] == {("t", 0, 3): cut[0], ("t", 1, 3): cut[1], ("t", 2, 3): cut[2], ("u", 0, 1): ["ff"]}


def test_rows_from_any_table(spark):
    df = spark.createDataFrame([(1, 9, 4)], "id int, a bigint, b bigint")
    row = spans_from_table(df, {"trace_id": "id", "start_time_unix_nano": "a", "end_time_unix_nano": F.col("b")}).first()
    assert (row["trace_id"], row["duration_nanos"], row["service_name"], row["attributes"]) == ("1", 0, "unknown_service", "{}")
    with pytest.raises(ValueError):
        logs_from_table(df, {"nope": "id"})


DAY = 86_400 * 10**9


def test_append_and_sweep(spark, tmp_path, make_spans, make_logs, make_points):
    path = str(tmp_path / "store")
    times = [1_000, 2_000, 5_000, DAY + 1, 3 * DAY + 5]
    tables = Telemetry(
        make_spans(*[(f"t{t}", "s", "", "svc", t, t + 1) for t in times]),
        make_logs(*[{"time_unix_nano": t} for t in times]),
        make_points(*[{"time_unix_nano": t} for t in times]),
    )
    append_all(tables, path)
    append_all(Telemetry(*(df.limit(0) for df in tables)), path)
    assert [df.count() for df in read_tables(spark, path)] == [5, 5, 5]
    assert sweep_expired(spark, path, 2_000) == (1, 1, 1)
    assert sweep_expired(spark, path, 2_000) == (0, 0, 0)
    assert {tuple(r) for r in expired_counts(tables, 2_000).collect()} == {(n, 1, 4) for n in ("spans", "logs", "metric_points")}
    assert sweep_expired(spark, path, 3 * DAY) == (3, 3, 3)
    assert [r["time_unix_nano"] for r in read_tables(spark, path).logs.collect()] == [3 * DAY + 5]
    assert sweep_expired(spark, path, 9 * DAY) == (1, 1, 1)
    assert read_tables(spark, path).spans.count() == 0
    assert sweep_expired(spark, str(tmp_path / "nowhere"), 5) == (0, 0, 0)
    assert retention_cutoff(10, 60) == 0


def test_keep_newest(make_logs):
    logs = make_logs(*[{"time_unix_nano": t, "body": f"{t}-{i}"} for i, t in enumerate([5, 1, 9, 9, 9, 3, 7])])
    for n in range(9):
        kept = [r["time_unix_nano"] for r in keep_newest(logs, n).collect()]
        assert sorted(kept, reverse=True) == [9, 9, 9, 7, 5, 3, 1][:n]


def test_a_repeated_part_changes_nothing(spark, tmp_path, make_logs):
    rows = make_logs(*[{"time_unix_nano": i * DAY // 2, "body": f"b{i}"} for i in range(6)])
    path = str(tmp_path / "repeated")
    for _ in range(2):
        append(rows, path, "logs", part="stream-x-0")
    append(rows.limit(2), path, "logs")
    assert read_table(spark, path, "logs").count() == 8
    assert "part" not in read_table(spark, path, "logs").columns


def _times(spark, path):
    return sorted(r["time_unix_nano"] for r in read_table(spark, path, "logs").collect())


def _folders(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).glob("logs/event_date=*/part=*"))


def test_rows_appended_during_a_sweep_survive(spark, tmp_path, make_logs, monkeypatch):
    path = str(tmp_path / "busy")
    append(make_logs({"time_unix_nano": DAY + 5}, {"time_unix_nano": DAY + 50}, {"time_unix_nano": 1}), path, "logs")
    commit = retention.Store.commit

    def late(store, *how):
        append(make_logs({"time_unix_nano": DAY + 7}, {"time_unix_nano": 2}), path, "logs", part="late")
        monkeypatch.setattr(retention.Store, "commit", commit)
        return commit(store, *how)

    monkeypatch.setattr(retention.Store, "commit", late)
    assert sweep_expired(spark, path, DAY + 10).logs == 2
    assert _times(spark, path) == [2, DAY + 7, DAY + 50]
    assert sweep_expired(spark, path, DAY + 10).logs == 2 and _times(spark, path) == [DAY + 50]


@pytest.mark.parametrize("step", ["commit", "delete"])
def test_a_sweep_that_is_cut_short(spark, tmp_path, make_logs, monkeypatch, step):
    """Before its commit nothing has changed for readers, after it everything has; another sweep tidies up."""
    path = str(tmp_path / "cut")
    for part in range(3):
        append(make_logs(*[{"time_unix_nano": day * DAY + part} for day in range(4)]), path, "logs")
    before, folders = _times(spark, path), _folders(path)
    with monkeypatch.context() as patched:
        patched.setattr(retention.Store, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sweep_expired(spark, path, 2 * DAY + 1)
    want = [t for t in before if t >= 2 * DAY + 1]
    assert _times(spark, path) == (before if step == "commit" else want) and _folders(path) == folders
    assert sweep_expired(spark, path, 2 * DAY + 1).logs == (7 if step == "commit" else 0)
    # Cutoffs may also move back: what is gone stays gone.
    assert sweep_expired(spark, path, DAY).logs == 0
    assert _times(spark, path) == want
    assert len(_folders(path)) == 5  # two parts of the cutoff's date and three of the last
    assert sweep_expired(spark, path, 3 * DAY + 1).logs == 3 and len(_folders(path)) == 2
    append(make_logs({"time_unix_nano": 5}), path, "logs")
    assert _times(spark, path) == [5, 3 * DAY + 1, 3 * DAY + 2]


def test_sweeps_at_the_same_time(spark, tmp_path, make_logs):
    path = str(tmp_path / "two")
    append(make_logs({"time_unix_nano": 5}), path, "logs")
    store = retention.Store(spark, f"{path}/logs")
    first = store.retention()
    store.commit(first, frozenset(), {})
    with pytest.raises(RuntimeError, match="another sweep"):
        store.commit(first, frozenset(), {})
    assert _times(spark, path) == [5]


def test_an_absent_trace_skips_row_groups(spark, tmp_path, make_spans):
    """The id lies between those of the table, so only its bloom filter can tell that it is not there."""
    path = str(tmp_path / "bloom")
    append(make_spans(*[(f"{i:08d}", f"s{k}", "", "svc", i, i + 1) for i in range(0, 4000, 2) for k in range(2)]), path, "spans")
    spans = read_table(spark, path, "spans")

    def scanned(trace_id):
        found = traces.get_trace(spans, trace_id)
        rows = found.collect()
        (leaf,) = [found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)]
        return len(rows), leaf.metrics().get("numOutputRows").get().value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans whose scans can be looked at
    try:
        held, read = scanned("00002000")
        assert held == 2 and read > 0
        assert scanned("00002001") == (0, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")



def test_windows_prune_dates(spark, tmp_path, make_logs, make_spans, make_points):
    path = str(tmp_path / "pruned")
    append(make_logs(*[{"time_unix_nano": i * DAY} for i in range(5)]), path, "logs")
    append(make_spans(*[(f"t{i}", "s", "", "svc", i * DAY, i * DAY + 9) for i in range(5)]), path, "spans")
    append(make_points(*[{"time_unix_nano": i * DAY} for i in range(5)]), path, "metric_points")
    spans, records, points = read_tables(spark, path)
    window = {"time_min": 2 * DAY, "time_max": 3 * DAY}
    plans = [
        logs.query_logs(records, **window), logs.search_logs(records, F.lit(True), **window), logs.log_histogram(records, 5, **window),
        logs.log_fields(records, **window), traces.find_traces(spans, **window), traces.trace_ids(spans, **window),
        traces.search_traces(spans, None, **window), fields.trace_fields(spans, **window), metrics.metric_series(points, "m", **window),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in text
    assert logs.query_logs(records, **window).count() == 2 and traces.find_traces(spans, **window).count() == 2


def test_rejected_documents(spark):
    texts = ['{"resourceSpans":[]}', "{}", "", "  ", '{"resourceSpans":[', "[1]", "7", None, "nonsense"]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r.value for r in otlp_json.rejected_documents(lines).collect()) == sorted(['{"resourceSpans":[', "[1]", "7", "nonsense"])


def test_folder_with_broken_documents(spark, tmp_path):
    record = {"timeUnixNano": "3", "body": {"stringValue": "kept"}}
    good = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]})
    (tmp_path / "a.json").write_text(f"{good}\n{good[:40]}\n\n")
    (tmp_path / "b.json").write_text(f"not json\n{good}\n")
    parsed, rejected = otlp_json.read_documents(spark, str(tmp_path), otlp_json.LOG_DOCUMENTS)
    assert [r.body for r in otlp_json.flatten_logs(parsed).collect()] == ["kept", "kept"]
    assert sorted(r.value for r in rejected.collect()) == ["not json", good[:40]]


def test_nesting_adds_no_pieces_and_values_are_read_once(spark):
    """A chain of 60 levels stays one piece; around every container stands what belongs to it."""
    deep = '{"k":[' * 30 + "1" + "]}" * 30
    wide = '{"a":[],"b":{},"c":[[1,{"d":[true,null]}],"x"],"e":{"f":{"g":[{}]}}}'
    rows = spark.createDataFrame([(1, f'{{"v":{deep}}}'), (2, wide), (3, "{}"), (4, "nope"), (5, None)], "i int, t string")
    lists = rows.select("i", F.expr(otlp_export.key_values("t")).alias("pairs"))
    documents = lists.select(F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"'), "i", F.lit('","attributes":'), "pairs", F.lit("}]}]}]}")).alias("value"))
    logs = otlp_json.flatten_logs(otlp_json.parse_documents(documents, otlp_json.LOG_DOCUMENTS))
    assert {r["time_unix_nano"]: r["attributes"] for r in logs.collect()} == {1: f'{{"v":{deep}}}', 2: wide, 3: "{}", 4: "{}", 5: "{}"}
    first = "array(named_struct('t', '', 'a', true, 'v', parse_json('[[[[1]]]]'), 'u', ''))"
    opened = lambda p: f"IF(is_variant_null({p}.v), array(), {otlp.listed(f'CAST({p}.v AS ARRAY<VARIANT>)', 'p.t', lambda x, before, after: otlp.piece(before, 'true', x, after), 'p.u')})"
    turns = spark.range(1).select(F.expr(f"aggregate(array_repeat(0, 3), {first}, (s, n) -> flatten(transform(s, p -> {opened('p')})))").alias("s"))
    assert turns.select(F.size("s")).first()[0] == 1


def test_written_documents_are_compressed(spark, make_spans, tmp_path):
    spans = make_spans(*[("t", f"{i:04x}", "", "svc", i, i + 1) for i in range(3000)]).coalesce(1)
    documents = otlp_export.export_spans(spans, records=5)
    otlp_export.write_documents(documents, str(tmp_path / "d"))
    files = [f for f in (tmp_path / "d").iterdir() if f.name.startswith("part-")]
    size = documents.select(F.sum(F.length("value") + 1)).first()[0]
    assert 10 * sum(f.stat().st_size for f in files) < size and len(files) > 1
    parsed, rejected = otlp_json.read_documents(spark, str(tmp_path / "d"), otlp_json.SPAN_DOCUMENTS)
    assert rejected.count() == 0
    names = ("trace_id", "span_id", "name", "attributes")
    assert sorted(otlp_json.flatten_spans(parsed).select(*names).collect()) == sorted(spans.select(*names).collect())
