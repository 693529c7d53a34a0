import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import correlate, services, traces
from lumenspan.plans import forests
from lumenspan.sources.tables import Telemetry

MS = 1_000_000


def test_summaries(make_spans):
    spans = make_spans(
        ("ferry", "2", "1", "ramp", 7, 30), ("ferry", "1", "", "harbour", 5, 45), ("ferry", "3", "2", "ramp", 20, 61),
        ("tram", "9", "", "depot", 6, 8), ("bus", "4", "", "depot", 6, 7, {"status_code": 2}),
    )
    rows = traces.trace_summaries(spans).collect()
    # Newest first; equal starts in the order of their ids.
    assert [r["trace_id"] for r in rows] == ["bus", "tram", "ferry"]
    ferry = rows[2]
    assert (ferry["root_name"], ferry["span_count"], ferry["start_time_unix_nano"], ferry["duration_nanos"]) == ("op-1", 3, 5, 56)
    assert ferry["services"] == ["harbour", "ramp"] and rows[0]["services"] == ["depot"]


def test_partial_trace_uses_earliest_span(make_spans):
    spans = make_spans(("t", "x", "lost", "s1", 50, 60), ("t", "y", "lost", "s2", 20, 90))
    row = traces.trace_summaries(spans).first()
    assert (row["root_name"], row["start_time_unix_nano"], row["duration_nanos"]) == ("op-y", 20, 70)


@pytest.mark.parametrize("limit", [1, 4, 100])
def test_newest_of_a_service(make_spans, limit):
    rng = random.Random(limit)
    rows = [(f"trip-{i}", f"{i}", "", rng.choice(["north", "south", "east"]), rng.randrange(50), 60) for i in range(30)]
    want = sorted((r for r in rows if r[3] == "south"), key=lambda r: (-r[4], r[0]))[:limit]
    found = traces.find_traces(make_spans(*rows), limit, service="south").collect()
    assert [(r["trace_id"], r["start_time_unix_nano"]) for r in found] == [(r[0], r[4]) for r in want]


@pytest.fixture(scope="module")
def harbour(make_spans):
    cargo = lambda **a: {"attributes": a}
    return make_spans(
        ("a", "11", "", "crane", 300, 350, cargo(load="coal", tons=40)), ("a", "12", "11", "scale", 310, 320, {"status_code": 2}),
        ("b", "21", "", "crane", 100, 180, cargo(load="grain")), ("b", "22", "21", "scale", 120, 130), ("b", "23", "21", "customs", 140, 170),
        ("c", "31", "", "pilot", 200, 900, cargo(load="coal")),
    ).cache()


def test_lists(harbour):
    assert [r[0] for r in traces.list_services(harbour).collect()] == ["crane", "customs", "pilot", "scale"]
    assert sorted(r[0] for r in traces.list_operations(harbour, "scale").collect()) == ["op-12", "op-22"]
    assert traces.list_operations(harbour).count() == 6
    assert [r[0] for r in traces.trace_ids(harbour, 2).collect()] == ["a", "c"]


def test_finding_keeps_the_whole_trace(harbour):
    found = lambda **f: [(r["trace_id"], r["span_count"]) for r in traces.find_traces(harbour, **f).collect()]
    assert found(errors_only=True) == [("a", 2)]
    assert found(service="customs") == [("b", 3)]
    assert found(attribute="load=coal") == [("a", 2), ("c", 1)]
    assert found(min_duration=100) == [("c", 1)]
    assert found(attribute="load=wood") == []


def test_getting_a_trace(harbour):
    assert [r["span_id"] for r in traces.get_trace(harbour, "b").collect()] == ["21", "22", "23"]
    assert traces.get_trace(harbour, "z").collect() == []


def test_tree_depth_orphans_and_cycles(make_spans):
    spans = make_spans(
        ("t", "a", "", "s", 0, MS),
        ("t", "c", "b", "s", 200, 300),
        ("t", "b", "a", "s", 100, 400),
        ("t", "b2", "a", "s", 50, 60),
        ("t", "o", "lost", "s", 10, 20),
        ("t", "o1", "o", "s", 12, 15),
        ("t", "me", "me", "s", 30, 40),
        ("t", "x", "y", "s", 1, 2),
        ("t", "y", "x", "s", 1, 2),
    )
    rows = traces.trace_tree(spans, ordered=True).collect()
    found = [(r["span_id"], r["depth"]) for r in rows]
    assert found[:7] == [("a", 0), ("b2", 1), ("b", 1), ("c", 2), ("o", 0), ("o1", 1), ("me", 0)]
    # Spans on a cycle have no top; they are kept without a place.
    assert sorted(found[7:]) == [("x", None), ("y", None)]
    assert rows[0]["width_share"] == 1.0 and rows[3]["offset_nanos"] == 200


def test_chain_of_ten_thousand(spark, make_spans):
    """Span i starts at i and is called by span i - 1; a cycle and what hangs below it end the search, too."""
    chain = spark.range(10_000).select(
        F.lit("t").alias("trace_id"), F.concat(F.lit("s"), "id").alias("span_id"), F.col("id").alias("start_time_unix_nano"),
        F.when(F.col("id") > 0, F.concat(F.lit("s"), F.col("id") - 1)).otherwise("").alias("parent_span_id"),
        F.lit(20_000).cast("bigint").alias("end_time_unix_nano"),
    )
    ring = make_spans(("u", "x", "z", "s", 1, 2), ("u", "y", "x", "s", 1, 2), ("u", "z", "y", "s", 1, 2), ("u", "below", "y", "s", 3, 4), ("u", "top", "", "s", 0, 9))
    tree = traces.trace_tree(ring.unionByName(chain, allowMissingColumns=True))
    assert tree.filter("trace_id = 't'").filter("depth = position and depth = start_time_unix_nano").count() == 10_000
    assert {r["span_id"]: (r["depth"], r["position"]) for r in tree.filter("trace_id = 'u'").collect()} == {
        "top": (0, 0), "x": (None, None), "y": (None, None), "z": (None, None), "below": (None, None),
    }


def test_positions_against_a_walk(make_spans):
    rng = random.Random(5)
    rows, want = [], {}
    for trace in range(12):
        parents = {f"{trace}.{i}": "" if rng.random() < 0.1 else f"{trace}.{rng.randrange(i)}" if i else "" for i in range(rng.randrange(1, 60))}
        parents |= {f"{trace}.orphan{i}": "lost" for i in range(trace % 3)}
        starts = {span: rng.randrange(30) for span in parents}
        rows += [(f"t{trace}", span, parent, "s", starts[span], 99) for span, parent in parents.items()]
        order = []

        def walk(parent, depth):
            for span in sorted((x for x, p in parents.items() if (p if p in parents else "") == parent), key=lambda x: (starts[x], x)):
                order.append((span, depth))
                walk(span, depth + 1)

        walk("", 0)
        want |= {(f"t{trace}", span): (depth, at) for at, (span, depth) in enumerate(order)}
    rng.shuffle(rows)
    found = traces.span_positions(make_spans(*rows, *rows[:20])).collect()
    assert {(r["trace_id"], r["span_id"]): (r["depth"], r["position"]) for r in found} == want and len(found) == len(want)


def test_small_traces_meet_once_and_large_ones_are_ranked_in_rounds(make_spans, monkeypatch, capsys):
    rng = random.Random(6)
    rows = []
    for trace, n in enumerate((1, 9, 60, 3, 200)):
        spans = [(f"{trace}.{i}", f"{trace}.{rng.randrange(n)}" if rng.random() < 0.8 else rng.choice(["", "lost"])) for i in range(n)]
        rows += [(f"t{trace}", span, parent, "s", rng.randrange(5), 99) for span, parent in spans]
    spans = make_spans(*rows, *rows[:30])
    capsys.readouterr()
    tree = traces.trace_tree(spans)
    tree.explain()
    # Rows are moved once, to their trace.
    assert capsys.readouterr().out.count("Exchange") == 1
    text = lambda df: sorted(str(r) for r in df.collect())
    at_once = text(tree)
    for limit in (50, 0):
        monkeypatch.setattr(traces, "SPANS_IN_TASK", limit)
        assert text(traces.trace_tree(spans)) == at_once


def test_batches_cut_anywhere_place_the_same():
    rows = [(f"t{i // 7}", f"s{i}", f"s{i - 1}" if i % 7 else "", 100 - i, 7) for i in range(70)]
    table = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["trace_id", "span_id", forests.PARENT, forests.ORDER, forests.SIZE])
    for size in (1, 3, 7, 70):
        placed = pa.Table.from_batches(forests.place_batches(iter(table.to_batches(max_chunksize=size))))
        assert placed["depth"].to_pylist() == placed["position"].to_pylist() == [i % 7 for i in range(70)]
    with pytest.raises(RuntimeError):
        list(forests.place_batches(iter(table.slice(1).to_batches())))


def test_completeness(make_spans):
    spans = make_spans(
        ("t1", "a", "", "s", 0, 1), ("t1", "b", "a", "s", 0, 1), ("t2", "c", "lost", "s", 0, 1), ("t2", "d", "lost", "s", 0, 1)
    )
    rows = {r["trace_id"]: r for r in traces.trace_completeness(spans).collect()}
    assert (rows["t1"]["orphan_count"], rows["t1"]["root_missing"]) == (0, False)
    assert (rows["t2"]["orphan_count"], rows["t2"]["root_missing"]) == (2, True)


def _market(make_spans):
    """Two orders at a stall: the first asks the scale three times (one failure), the second once and then the till."""
    return make_spans(
        ("o1", "s1", "", "stall", 5, 5 + 30 * MS),
        ("o1", "w1", "s1", "scale", 10, 10 + 1 * MS, {"kind": "client"}),
        ("o1", "w2", "s1", "scale", 20, 20 + 2 * MS, {"kind": "client", "status_code": 2}),
        ("o1", "w3", "s1", "scale", 30, 30 + 6 * MS, {"kind": "client"}),
        ("o2", "s2", "", "stall", 100, 100 + 50 * MS),
        ("o2", "w4", "s2", "scale", 110, 110 + 7 * MS, {"kind": "client"}),
        ("o2", "p1", "w4", "till", 120, 120 + 3 * MS, {"kind": "internal"}),
    )


def test_market_statistics_and_graph(make_spans):
    spans = _market(make_spans)
    stats = {r["service_name"]: r for r in services.service_stats(spans).collect()}
    assert {n: (r["span_count"], r["request_count"], r["error_count"]) for n, r in stats.items()} == {
        "stall": (2, 2, 0), "scale": (4, 1, 1), "till": (1, 1, 0),
    }
    assert stats["scale"]["error_rate"] == 0.25
    # Index round(3 p) of 1, 2, 6, 7: halves go up.
    assert (stats["scale"]["p50_ms"], stats["scale"]["p95_ms"]) == (6.0, 7.0)
    assert services.unhealthy_first(services.service_stats(spans)).first()["service_name"] == "scale"
    edges = services.service_graph_edges(spans)
    found = {(r["source"], r["target"]): (r["calls"], r["errors"], r["avg_ms"]) for r in edges.collect()}
    assert found == {("stall", "scale"): (4, 1, 4.0), ("scale", "till"): (1, 0, 3.0)}
    near = services.filter_graph(services.service_graph_nodes(spans), edges, "TILL")
    assert [df.count() for df in near] == [1, 0]
    assert services.service_stats(spans, approximate=True).filter("service_name = 'stall'").first()["p99_ms"] == 50.0
    newest = services.service_stats(spans, sample_traces=1).collect()
    assert {r["service_name"]: r["span_count"] for r in newest} == {"stall": 1, "scale": 1, "till": 1}


def test_graph_edges_with_resent_parent_and_hot_parent(make_spans):
    rows = [("t", "p", "", "front", 0, 5), ("t", "p", "", "front", 0, 5)]
    rows += [("t", f"c{i}", "p", "back", 1, 3, {"status_code": 2 if i < 30 else 0}) for i in range(100)]
    edge = services.service_graph_edges(make_spans(*rows)).collect()
    assert [(r["calls"], r["errors"]) for r in edge] == [(100, 30)]


def test_investigate_and_correlation(make_spans, make_logs, make_points):
    spans = _market(make_spans)
    logs = make_logs(
        *[{"trace_id": "o1", "span_id": "w2", "time_unix_nano": i, "body": f"n{i}"} for i in range(5)],
        {"trace_id": "o2", "span_id": "none", "time_unix_nano": 9},
        {"trace_id": "", "span_id": "", "time_unix_nano": 10},
    )
    exemplar = lambda trace, span, time: [(trace, span, time, 1.0)]
    points = make_points({"name": "m1", "exemplars": exemplar("O1", "s1", 1)}, {"name": "m2", "exemplars": exemplar("o9", "s1", 2)})
    bundle = traces.investigate(spans, logs, points, ["o1", "absent"], logs_per_trace=3)
    status = {r["trace_id"]: (r["found"], r["span_count"], r["error_count"]) for r in bundle.status.collect()}
    assert status == {"o1": (True, 4, 1), "absent": (False, 0, 0)}
    assert sorted(r["body"] for r in bundle.logs.collect()) == ["n2", "n3", "n4"]
    assert [r["metric_name"] for r in bundle.exemplars.collect()] == ["m1"]
    assert bundle.errors.count() == 1
    table = spans.filter("service_name = 'scale'").select("trace_id")
    again = traces.investigate(spans, logs, points, table, logs_per_trace=3)
    assert {r["trace_id"]: r["span_count"] for r in again.status.collect()} == {"o1": 4, "o2": 3}
    assert sorted(r["body"] for r in again.logs.filter("trace_id = 'o1'").collect()) == ["n2", "n3", "n4"]
    assert [r["metric_name"] for r in again.exemplars.collect()] == ["m1"]

    linked = correlate.traces_of_logs(logs, spans)
    assert linked.count() == 7
    assert linked.filter(F.col("span_service") == "scale").count() == 5
    ids = spans.filter("status_code = 2")
    assert correlate.logs_of_traces(logs, ids).count() == 5
    assert [r["body"] for r in correlate.logs_of_traces(logs, ids, "w2", 2).collect()] == ["n4", "n3"]
    assert [r["metric_name"] for r in correlate.metrics_of_traces(points, ids).collect()] == ["m1"]
    own = correlate.service_signals(Telemetry(spans, logs, points), "svc", 5)
    assert [df.count() for df in own] == [0, 7, 2]
    stats = services.storage_stats(spans, logs, points).first()
    assert tuple(stats) == (7, 7, 2, 4)


def test_newest_logs_of_a_trace_with_very_many(spark, make_logs):
    rows = spark.range(30_000).select(F.lit("hot").alias("trace_id"), ((F.col("id") * 7919) % 30_000).alias("time_unix_nano"), F.col("id").cast("string").alias("body"))
    logs = make_logs({"trace_id": "one", "time_unix_nano": 3}).unionByName(rows, allowMissingColumns=True)
    kept = correlate.newest_per_trace(logs, 5000)
    assert kept.columns == logs.columns
    assert kept.groupBy("trace_id").agg(F.count("*"), F.min("time_unix_nano")).orderBy("trace_id").collect() == [("hot", 5000, 25_000), ("one", 1, 3)]
