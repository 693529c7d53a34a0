"""Span conditions over one parcel's trace of five spans, each family of conditions in a test of its own."""

import operator
import re
from functools import reduce

import pytest

from lumenspan.functions import spansets as S
from lumenspan.operators import traces

MS = 1_000_000
w, one, agg = S.where, S.span_set, S.aggregate


@pytest.fixture(scope="module")
def parcel(make_spans):
    def span(number, parent, service, start, end, name, status=1, kind="internal", **attributes):
        extra = {
            "name": name, "status_code": status, "kind": kind, "attributes": attributes,
            "resource_attributes": {"service.name": service, "site": {"hall": 3}},
        }
        return ("parcel-7", number, parent, service, start * MS, end * MS, extra)

    return make_spans(
        span("1", "", "depot", 0, 900, "accept parcel", kind="consumer", weight=2.5, fragile=True),
        span("2", "1", "scale", 10, 70, "weigh", weight=2.5, unit="kg"),
        span("3", "1", "printer", 80, 200, "print label", status=2, attempt=1, reason="paper jam"),
        span("4", "1", "printer", 220, 300, "print label", attempt=2, reason=None),
        span("5", "4", "archive", 240, 290, "store copy", status=0, kind="producer", **{"box.id": "B-12", "pages": "4"}),
    ).cache()


@pytest.fixture
def matches(parcel):
    def check(condition):
        return traces.matching_traces(parcel, condition).count() == 1

    return check


YES_NO = {
    "attribute_scopes": (
        [w("span.unit", "=", "kg"), w("resource.site.hall", "=", 3), w("box.id", "=", "B-12"), w(".service.name", "=", "scale")],
        [w("resource.unit", "=", "kg"), w("span.site.hall", "=", 3), w("unit", "=", "lb"), w("span.service.name", "=", "scale")],
    ),
    "numbers": (
        [w("weight", ">=", 2.5), w("attempt", ">", 1), w("pages", "<", 5), w("attempt", "!=", 1), w("fragile", ">", 0)],
        [w("weight", ">", 2.5), w("attempt", ">", 2), w("unit", "<", 100), w("unit", ">", "a"), w("absent", "<", 1)],
    ),
    "flags_and_nulls": (
        [w("fragile", "=", True), S.exists("reason"), ~S.exists("colour"), ~w("colour", "=", "red")],
        [w("fragile", "=", False), S.exists("colour"), w("colour", "!=", "red"), S.exists("span.hall")],
    ),
    "intrinsics": (
        [w("status", "=", "error"), w("status", "=", "unset"), w("kind", "=", "producer"), w("duration", "=", 120 * MS), w("name", "=", "weigh")],
        [w("kind", "=", "server"), w("duration", ">", 900 * MS), w("duration", "<", 50 * MS), w("name", "=", "label")],
    ),
    "patterns": (
        [S.matches("name", "^print"), S.matches("name", "print", negate=True), S.matches("box.id", "[0-9]+$")],
        [S.matches("name", "^label"), S.matches("name", "e|s", negate=True), S.matches("colour", ".", negate=True)],
    ),
    "whole_trace": (
        [w("rootName", "=", "accept parcel"), w("rootServiceName", "!=", "printer"), w("traceDuration", "=", 900 * MS)],
        [w("rootName", "=", "weigh"), w("rootServiceName", "=", "printer"), w("traceDuration", "<", 900 * MS)],
    ),
    "on_one_span": (
        [w("name", "=", "print label") & w("status", "=", "error"), w("attempt", "=", 2) & ~w("status", "=", "error"), w("unit", "=", "lb") | w("pages", "=", 4)],
        [w("attempt", "=", 2) & w("status", "=", "error"), w("unit", "=", "kg") & w("fragile", "=", True), ~S.exists("site.hall")],
    ),
    "span_and_trace": (
        [w("attempt", "=", 1) & w("traceDuration", ">", 800 * MS), w("traceDuration", ">", 5000 * MS) | w("unit", "=", "kg")],
        [w("attempt", "=", 1) & w("rootName", "=", "weigh"), w("rootName", "=", "weigh") & w("unit", "=", "kg") | w("traceDuration", ">", 950 * MS) & w("attempt", "=", 1)],
    ),
}


@pytest.mark.parametrize("family", YES_NO)
def test_conditions(matches, family):
    yes, no = YES_NO[family]
    assert [matches(one(c)) for c in yes] == [True] * len(yes)
    assert [matches(one(c)) for c in no] == [False] * len(no)


def test_sets_are_asked_of_different_spans(matches):
    jam, weighed, lost = one(w("status", "=", "error")), one(w("unit", "=", "kg")), one(w("name", "=", "lost"))
    assert matches(jam & weighed) and matches(lost | weighed) and matches((lost | jam) & weighed)
    assert not matches(jam & lost) and not matches(one(w("status", "=", "error") & w("unit", "=", "kg")))
    assert matches(one())


@pytest.mark.parametrize(
    ("function", "field", "value"),
    [("count", None, 5), ("sum", "attempt", 3), ("max", "duration", 900 * MS), ("min", "duration", 50 * MS), ("avg", "weight", 2.5), ("sum", "traceDuration", 4500 * MS)],
)
def test_aggregates(matches, function, field, value):
    assert matches(one(None, agg(function, field, "=", value)))
    assert matches(one(None, agg(function, field, "<=", value)))
    assert not matches(one(None, agg(function, field, ">", value)))
    assert not matches(one(None, agg(function, field, "!=", value)))


def test_aggregates_of_chosen_spans(matches):
    label = w("name", "=", "print label")
    assert matches(one(label, agg("count", None, "=", 2), agg("sum", "duration", "=", 200 * MS)))
    assert not matches(one(label, agg("count", None, "=", 2), agg("sum", "duration", "=", 201 * MS)))
    # A set needs a span, and an average needs a value.
    assert not matches(one(w("name", "=", "lost"), agg("count", None, "=", 0)))
    assert not matches(one(None, agg("avg", "colour", ">=", 0)))


def test_no_spans_no_trace(parcel):
    assert traces.matching_traces(parcel.limit(0), one()).count() == 0


def test_search_among_traces(make_spans):
    spans = make_spans(
        ("calm", "1", "", "depot", 50, 90, {"attributes": {"lane": "north"}}),
        ("busy", "2", "", "depot", 10, 20, {"attributes": {"lane": "north"}}),
        ("busy", "3", "2", "belt", 12, 4012, {"status_code": 2, "attributes": {"lane": "south"}}),
        ("lone", "4", "", "belt", 70, 75),
    )
    found = lambda c=None, **f: [r["trace_id"] for r in traces.search_traces(spans, c, **f).collect()]
    assert found() == ["lone", "calm", "busy"]
    assert found(one(w("lane", "=", "north"))) == ["calm", "busy"]
    assert found(one(w("lane", "=", "north")) & one(w("lane", "=", "south"))) == ["busy"]
    assert found(one(w("duration", ">=", 4000))) == ["busy"]
    assert found(service="belt") == ["lone", "busy"]
    assert found(one(w("status", "=", "ok"))) == []


def test_many_alternatives_on_the_whole_trace(make_spans):
    """Twelve alternatives of root and step: columns grow with the tests, not with the answers' combinations."""
    rows = []
    for i in range(14):
        rows += [(f"t{i}", f"r{i}", "", "root", 10 * i, 10 * i + 5, {"name": f"root {i}"})]
        rows += [(f"t{i}", f"s{i}.{k}", f"r{i}", "step", 10 * i + 1, 10 * i + 2, {"name": f"step {(i + k) % 14}", "attributes": {"w": k}}) for k in range(3)]
    spans = make_spans(*rows)
    alternatives = [w("rootName", "=", f"root {i}") & w("name", "=", f"step {i + 1 if i % 2 else i + 5}") for i in range(12)]
    either = reduce(operator.or_, alternatives)
    found = traces.search_traces(spans, one(either), None)
    # The step after the own one is there, the fifth one is not.
    assert sorted(r["trace_id"] for r in found.collect()) == sorted(f"t{i}" for i in range(12) if i % 2)
    widest = max(len(re.findall(r"\w+\(", line)) for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line)
    assert widest <= 24
    roots = reduce(operator.or_, (w("rootName", "=", f"root {i}") for i in range(12)))
    for function, value, want in (("count", 4, 12), ("sum", 3, 12), ("max", 2, 12), ("min", 0, 12), ("avg", 1, 12), ("avg", 2, 0)):
        assert traces.matching_traces(spans, one(roots, agg(function, "w", "=", value))).count() == want


def test_masks_hold_more_tests_than_one_column(make_spans):
    spans = make_spans(("t", "a", "", "s", 0, 9, {"name": "n99"}), ("u", "b", "", "s", 0, 9, {"name": "n7"}), ("v", "c", "", "s", 0, 9, {"name": "other"}))
    many = reduce(operator.or_, (w("name", "=", f"n{i}") for i in range(100)))
    got = traces.matching_traces(spans, one(many & w("rootName", "!=", "n7")))
    assert [r["trace_id"] for r in got.collect()] == ["t"]


def test_plain_columns_are_asked_before_documents():
    document, plain = S.where("returned", ">=", 1), S.where("name", "=", "line 5")
    for both in (document & plain, plain & document, (document & S.exists("x")) & plain):
        text = str(both.possible())
        assert text.index("line 5") < text.index("returned")
    either = str((document | plain).possible())
    assert either.index("line 5") < either.index("returned")
