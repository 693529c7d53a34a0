"""Conditions on the spans of one trace.

``where(field, op, value)``, ``matches`` and ``exists`` describe one span; ``&``, ``|`` and ``~`` combine
them on the *same* span.  ``span_set`` asks that some span of the trace satisfies a condition (and that
aggregates over those spans hold); span sets combine with ``&`` and ``|`` per trace.

Fields: ``name``, ``duration``, ``status``, ``kind``; ``rootName``, ``rootServiceName`` and
``traceDuration`` for the whole trace; ``span.x``, ``resource.x`` and ``.x`` (or ``x``) for attributes.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.jsontext import JsonValue, lookup, number_text, parse_number, plain, plain_number, truth

# Status words and their codes.
STATUS_CODES = {"unset": 0, "ok": 1, "error": 2}

SPAN_INTRINSICS = {"name": "name", "duration": "duration_nanos", "status": "status_code", "kind": "kind"}
TRACE_INTRINSICS = {
    "rootName": "root_name",
    "rootServiceName": "root_service",
    "traceDuration": "duration_nanos",
}
NUMERIC_INTRINSICS = {"duration", "status", "traceDuration"}

Literal = str | int | float | bool


def is_trace_field(name: str) -> bool:
    return name in TRACE_INTRINSICS


def _field_value(name: str, trace: Callable[[str], Column] | None) -> JsonValue:
    """Value of a field on one span; ``trace`` reads a column of the trace aggregate."""
    read = plain_number if name in NUMERIC_INTRINSICS else plain
    if is_trace_field(name):
        return read(trace(TRACE_INTRINSICS[name]))
    if name in SPAN_INTRINSICS:
        return read(F.col(SPAN_INTRINSICS[name]))
    for scope, document in (("span.", "attributes"), ("resource.", "resource_attributes")):
        if name.startswith(scope):
            return lookup(document, name.removeprefix(scope))
    key = name.removeprefix(".")
    if key == "service.name":
        return plain(F.col("service_name"))
    own, inherited = lookup("attributes", key), lookup("resource_attributes", key)
    kind = F.when(own.present, own.type_name).otherwise(inherited.type_name)
    return JsonValue(F.coalesce(own.text, inherited.text), kind)


def _literal_number(value: Literal) -> float | None:
    if isinstance(value, bool):
        return 1.0 if value else 0.0
    if isinstance(value, int | float):
        return float(value)
    return float(STATUS_CODES[value]) if value in STATUS_CODES else parse_number(value)


def _literal_text(value: Literal) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else number_text(value)


def _compare(op: str, left: Column, right: Column) -> Column:
    return {
        "=": left == right,
        "!=": left != right,
        ">": left > right,
        ">=": left >= right,
        "<": left < right,
        "<=": left <= right,
    }[op]


def compare_number(op: str, actual: Column, expected: float) -> Column:
    """IEEE comparison: NaN differs from everything and is in no order."""
    return F.when(F.isnan(actual), F.lit(op == "!=")).otherwise(_compare(op, actual, F.lit(expected)))


def _holds(op: str, value: Literal, actual: JsonValue) -> Column:
    text = _literal_text(value)
    as_text = _compare(op, actual.text, F.lit(text)) if op in ("=", "!=") else F.lit(False)
    expected = _literal_number(value)
    if expected is None:
        return truth(actual.present & as_text)
    number = actual.number
    either = F.when(number.isNotNull(), compare_number(op, number, expected)).otherwise(as_text)
    return truth(F.when(actual.present, either))


Trace = Callable[[str], Column]


@dataclass(frozen=True)
class Condition:
    """A condition on one span.

    ``build`` combines the answers of numbered tests.  ``span_tests`` look at the span itself; ``trace_tests`` look
    at its whole trace, through a function that reads a column of the trace aggregate.  Of two conditions the one with
    fewer ``lookups`` in documents is asked first; the other is then asked of few spans.
    """

    build: Callable[[Callable[[int], Answer]], Answer]
    span_tests: dict[int, Callable[[], Column]] = field(default_factory=dict)
    trace_tests: dict[int, Callable[[Trace], Column]] = field(default_factory=dict)
    lookups: int = 0

    def _merged(self, other: Condition) -> tuple[dict, dict]:
        return {**self.span_tests, **other.span_tests}, {**self.trace_tests, **other.trace_tests}

    def _ordered(self, other: Condition) -> list[Condition]:
        return sorted((self, other), key=lambda c: c.lookups)

    def __and__(self, other: Condition) -> Condition:
        first, then = self._ordered(other)
        return Condition(lambda answer: first.build(answer) & then.build(answer), *self._merged(other), self.lookups + other.lookups)

    def __or__(self, other: Condition) -> Condition:
        first, then = self._ordered(other)
        return Condition(lambda answer: first.build(answer) | then.build(answer), *self._merged(other), self.lookups + other.lookups)

    def __invert__(self) -> Condition:
        return Condition(lambda answer: ~self.build(answer), self.span_tests, self.trace_tests, self.lookups)

    def possible(self) -> Column:
        """Whether the span can satisfy the condition, whatever its trace answers."""

        def answer(number: int) -> Answer:
            if number in self.trace_tests:
                return Answer(F.lit(True), F.lit(True))
            test = self.span_tests[number]()
            return Answer(test, ~test)

        return self.build(answer).can_hold

    def holds(self, known: Callable[[int], Column]) -> Column:
        """The condition with every test answered."""

        def answer(number: int) -> Answer:
            column = known(number)
            return Answer(column, ~column)

        return self.build(answer).can_hold


@dataclass(frozen=True)
class Answer:
    """Whether a condition can hold and whether it can fail; both where it depends on something still unknown."""

    can_hold: Column
    can_fail: Column

    def __and__(self, other: Answer) -> Answer:
        return Answer(self.can_hold & other.can_hold, self.can_fail | other.can_fail)

    def __or__(self, other: Answer) -> Answer:
        return Answer(self.can_hold | other.can_hold, self.can_fail & other.can_fail)

    def __invert__(self) -> Answer:
        return Answer(self.can_fail, self.can_hold)


_test_numbers = itertools.count()


def _span_test(test: Callable[[], Column], lookups: int = 1) -> Condition:
    number = next(_test_numbers)
    return Condition(lambda answer: answer(number), {number: test}, {}, lookups)


def _condition(name: str, test: Callable[[JsonValue], Column]) -> Condition:
    if not is_trace_field(name):
        plain_column = name in SPAN_INTRINSICS or name.removeprefix(".") == "service.name"
        return _span_test(lambda: truth(_field_value(name, None).let(test)), 0 if plain_column else 1)
    number = next(_test_numbers)
    return Condition(lambda answer: answer(number), {}, {number: lambda trace: truth(test(_field_value(name, trace)))})


def column(condition: Column) -> Condition:
    """Any two-valued Column over the spans as a condition."""
    return _span_test(lambda: truth(condition))


def where(name: str, op: str, value: Literal) -> Condition:
    """``= != > >= < <=``; a missing field satisfies nothing, not even ``!=``."""
    return _condition(name, partial(_holds, op, value))


def matches(name: str, pattern: str, negate: bool = False) -> Condition:
    """Unanchored regular expression on the text of a field that is present."""

    def test(actual: JsonValue) -> Column:
        hit = actual.text.rlike(pattern)
        return truth(~hit if negate else hit)

    return _condition(name, test)


def exists(name: str) -> Condition:
    """The field is present; a JSON null counts."""
    return _condition(name, lambda actual: actual.present)


@dataclass(frozen=True)
class Aggregate:
    """``count``, ``avg``, ``sum``, ``min`` or ``max`` over the matched spans, compared with a number."""

    function: str
    field: str | None
    op: str
    value: Literal


def aggregate(function: str, field: str | None, op: str, value: Literal) -> Aggregate:
    return Aggregate(function, field, op, value)


@dataclass(frozen=True)
class SpanSet:
    """At least one span satisfies the condition and every aggregate over those spans holds."""

    condition: Condition
    aggregates: tuple[Aggregate, ...] = ()

    def __and__(self, other: TraceCondition) -> TraceCondition:
        return Combined("and", self, other)

    def __or__(self, other: TraceCondition) -> TraceCondition:
        return Combined("or", self, other)


@dataclass(frozen=True)
class Combined:
    """Two trace conditions; different spans may satisfy each."""

    op: str
    left: SpanSet | Combined
    right: SpanSet | Combined

    def __and__(self, other: TraceCondition) -> TraceCondition:
        return Combined("and", self, other)

    def __or__(self, other: TraceCondition) -> TraceCondition:
        return Combined("or", self, other)


TraceCondition = SpanSet | Combined


def span_set(condition: Condition | None = None, *aggregates: Aggregate) -> SpanSet:
    """Without a condition every span of the trace belongs to the set."""
    return SpanSet(condition or column(F.lit(True)), aggregates)


def any_span(condition: Column) -> SpanSet:
    """The trace rule of record predicates: one span satisfies the whole predicate."""
    return span_set(column(condition))


#: Answers of span tests that one mask column holds.
MASK_BITS = 62
AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def _sets(condition: TraceCondition) -> list[SpanSet]:
    return [condition] if isinstance(condition, SpanSet) else _sets(condition.left) + _sets(condition.right)


def _number(a: Aggregate) -> Column | None:
    """The numbers an aggregate takes from spans; None if it needs no more than their count."""
    if a.function == "count" or is_trace_field(a.field) or _literal_number(a.value) is None:
        return None
    number = _field_value(a.field, None).let(lambda value: value.number)
    return F.when(~F.isnan(number), number) if a.function in ("min", "max") else number


def _checked(a: Aggregate, count: Column, taken: Column | None, trace: Trace) -> Column:
    """Whether an aggregate holds, from the count of the set's spans and what was taken from them."""
    expected = _literal_number(a.value)
    if expected is None:
        return F.lit(False)
    if a.function == "count":
        return compare_number(a.op, count.cast("double"), expected)
    if is_trace_field(a.field):
        # The same value on every span of the trace.
        taken = _field_value(a.field, trace).number
        taken = taken * count if a.function == "sum" else taken
    return truth(compare_number(a.op, taken, expected) & taken.isNotNull())


class TraceFlags:
    """The traces that satisfy a condition.

    Every span set needs a span, so only spans that can belong to a set leave their task.  Without tests of the
    whole trace, one aggregate over them decides.  With such tests, the answers of a set's span tests are the bits
    of a mask: spans are counted per trace and masks first, and the tests of the trace, answered once, decide
    afterwards which of its masks belong to the set.
    """

    def __init__(self, condition: TraceCondition):
        self.condition, self.sets = condition, _sets(condition)
        constant = any(a.function != "count" and is_trace_field(a.field) for s in self.sets for a in s.aggregates)
        self.needs_trace = constant or any(s.condition.trace_tests for s in self.sets)

    def matching(self, spans: DataFrame, context: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(trace_id) of matching traces; ``context`` gives the columns of a trace for the traces of given ids."""
        return self._by_masks(spans, context) if self.needs_trace else self._at_once(spans)

    def _decided(self, holds: list[Column]) -> Column:
        order = iter(holds)

        def of(condition: TraceCondition) -> Column:
            if isinstance(condition, SpanSet):
                return next(order)
            left, right = of(condition.left), of(condition.right)
            return left & right if condition.op == "and" else left | right

        return of(self.condition)

    def _numbers(self) -> dict[str, tuple[int, Aggregate, Column]]:
        """By column name: set, aggregate and the numbers it takes."""
        return {
            f"__n{i}_{j}": (i, a, number)
            for i, s in enumerate(self.sets) for j, a in enumerate(s.aggregates) if (number := _number(a)) is not None
        }

    def _at_once(self, spans: DataFrame) -> DataFrame:
        inside = {f"__in{i}": s.condition.possible() for i, s in enumerate(self.sets)}
        numbers = self._numbers()
        columns = [c.alias(n) for n, c in inside.items()] + [F.when(inside[f"__in{i}"], c).alias(n) for n, (i, _, c) in numbers.items()]
        rows = spans.select("trace_id", *columns).filter(reduce(operator.or_, map(F.col, inside)))
        counts = [F.count_if(F.col(n)).alias(n) for n in inside]
        grouped = rows.groupBy("trace_id").agg(*counts, *(AGGREGATES[a.function](n).alias(n) for n, (_, a, _) in numbers.items()))
        holds = []
        for i, s in enumerate(self.sets):
            count = F.col(f"__in{i}")
            checks = [_checked(a, count, F.col(f"__n{i}_{j}") if f"__n{i}_{j}" in numbers else None, F.col) for j, a in enumerate(s.aggregates)]
            holds.append(reduce(operator.and_, checks, count > 0))
        return grouped.filter(self._decided(holds)).select("trace_id")

    def _by_masks(self, spans: DataFrame, context: Callable[[DataFrame], DataFrame]) -> DataFrame:
        masks, places = {}, {}
        for i, s in enumerate(self.sets):
            for k, (number, test) in enumerate(s.condition.span_tests.items()):
                name = f"__m{i}_{k // MASK_BITS}"
                places[i, number] = name, 1 << k % MASK_BITS
                bit = F.when(test(), F.lit(1 << k % MASK_BITS)).otherwise(F.lit(0)).cast("bigint")
                masks[name] = masks[name].bitwiseOR(bit) if name in masks else bit
            masks.setdefault(f"__m{i}_0", F.lit(0).cast("bigint"))
        numbers = self._numbers()
        rows = spans.filter(reduce(operator.or_, (s.condition.possible() for s in self.sets)))
        rows = rows.select("trace_id", *(c.alias(n) for n, c in masks.items()), *(c.alias(n) for n, (_, _, c) in numbers.items()))
        taken = [
            F.struct(F.sum(n).alias("sum"), F.count(n).alias("count"), F.min(n).alias("min"), F.max(n).alias("max")).alias(n) for n in numbers
        ]
        counted = rows.groupBy("trace_id", *masks).agg(F.count("*").alias("__n"), *taken)
        # At most one entry for each combination of answers.
        listed = counted.groupBy("trace_id").agg(F.collect_list(F.struct(*masks, "__n", *numbers)).alias("__masks"))
        traces = context(listed.select("trace_id")).join(listed, "trace_id")
        holds = [self._set_holds(i, s, places, numbers) for i, s in enumerate(self.sets)]
        return traces.filter(self._decided(holds)).select("trace_id")

    def _set_holds(self, i: int, s: SpanSet, places: dict, numbers: dict) -> Column:
        answers = {n: test(F.col) for n, test in s.condition.trace_tests.items()}

        def inside(entry: Column) -> Column:
            def known(number: int) -> Column:
                if number in answers:
                    return answers[number]
                name, bit = places[i, number]
                return entry[name].bitwiseAND(F.lit(bit)) != 0

            return s.condition.holds(known)

        own = F.filter("__masks", inside)
        total = lambda part: F.aggregate(own, F.lit(0).cast("bigint"), lambda a, e: a + part(e))
        count = total(lambda e: e["__n"])
        checks = []
        for j, a in enumerate(s.aggregates):
            name = f"__n{i}_{j}"
            checks.append(_checked(a, count, _merged(own, name, a.function) if name in numbers else None, F.col))
        return reduce(operator.and_, checks, count > 0)


def _merged(entries: Column, name: str, function: str) -> Column:
    """An aggregate over the entries of several masks."""
    if function in ("min", "max"):
        ends = F.transform(entries, lambda e: e[name][function])
        return F.array_min(ends) if function == "min" else F.array_max(ends)
    known = F.filter(entries, lambda e: e[name]["count"] > 0)
    total = F.aggregate(known, F.lit(0.0), lambda a, e: a + e[name]["sum"])
    count = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, e: a + e[name]["count"])
    return F.when(count > 0, total / count if function == "avg" else total)
