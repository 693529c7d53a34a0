"""Record predicates: field and text conditions on one log record or one span.

Every method returns a two-valued Column over the columns of the table, so results combine with
``&``, ``|`` and ``~`` and are evaluated inside the scan's own stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspan.functions.filters import all_of, any_of
from lumenspan.functions.jsontext import JsonValue, body_value, lookup, number_of, parse_number, plain, plain_number, truth
from lumenspan.plans.limits import at_least

DEFAULT_EDITS = 2

# Punctuation that JSON text leaves around a word.
_EDGE_MARKS = '",{}[]:'


def severity_level(severity: Column | str) -> Column:
    """Level name of a severity number; ``unset`` outside 1..24."""
    number = F.col(severity) if isinstance(severity, str) else severity
    # Four severity numbers per level.
    names = ("trace", "debug", "info", "warn", "error", "fatal")
    level = F.lit("unset")
    for position, name in enumerate(names):
        level = F.when(number.between(4 * position + 1, 4 * position + 4), F.lit(name)).otherwise(level)
    return level


def _attributes(name: str) -> list[JsonValue]:
    return [lookup("attributes", name), lookup("resource_attributes", name)]


def log_values(name: str) -> list[JsonValue]:
    """Candidate values of a log field: a built-in name in any case, else both attribute maps."""
    builtin = name.lower()
    if builtin in ("service", "service.name", "service_name"):
        return [plain(F.col("service_name"))]
    if builtin in ("level", "severity"):
        return [plain(severity_level("severity_number")), plain(F.col("severity_text"))]
    if builtin in ("body", "message"):
        return [body_value(F.col("body"), F.col("body_json"))]
    if builtin == "scope":
        return [plain(F.col("scope_name"))]
    if builtin == "severity_number":
        return [plain_number(F.col(builtin))]
    if builtin in ("trace_id", "span_id"):
        return [plain(F.col(builtin))]
    return _attributes(name)


def span_values(name: str) -> list[JsonValue]:
    """Candidate values of a span field."""
    builtin = name.lower()
    # Field names and the column each one reads.
    columns = {
        "service": "service_name",
        "service.name": "service_name",
        "service_name": "service_name",
        "name": "name",
        "operation": "name",
        "kind": "kind",
        "status": "status_code",
        "status_code": "status_code",
        "status_message": "status_message",
        "duration": "duration_nanos",
        "duration_nanos": "duration_nanos",
        "trace_id": "trace_id",
        "span_id": "span_id",
        "parent_span_id": "parent_span_id",
        "scope": "scope_name",
    }
    if builtin in ("status", "status_code", "duration", "duration_nanos"):
        return [plain_number(F.col(columns[builtin]))]
    if builtin in columns:
        return [plain(F.col(columns[builtin]))]
    return _attributes(name)


def log_text() -> Column:
    return F.concat_ws(" ", "body", "attributes", "resource_attributes", "severity_text", "service_name")


def span_text() -> Column:
    return F.concat_ws(" ", "name", "service_name", "kind", "attributes", "resource_attributes")


def _like(text: Column, pattern: str, one: str = "") -> Column:
    """Case-insensitive glob over the whole text: ``*`` is any run, ``one`` a single character."""
    escaped = "".join("\\" + c if c in "%_\\" else c for c in pattern.lower())
    escaped = escaped.replace("*", "%")
    if one:
        escaped = escaped.replace(one, "_")
    return F.like(F.lower(text), F.lit(escaped))


def _wildcard(text: Column, pattern: str) -> Column:
    if "*" in pattern or "?" in pattern:
        return _like(text, pattern, one="?")
    return F.lower(text).contains(F.lower(F.lit(pattern)))


def _holds_words(text: Column, words: list[str]) -> Column:
    """Whether every plain word is in the text: without that no token has it, and the text need not be split."""
    plain_words = [word.lower().strip(_EDGE_MARKS) for word in words if "*" not in word and "?" not in word]
    return reduce(lambda found, word: found & F.lower(text).contains(F.lit(word)), plain_words, F.lit(True))


def _phrase_in_tokens(text: Column, words: list[str], slop: int) -> Column:
    """Words in order with at most ``slop`` tokens between neighbours.

    Each word takes the nearest token that fits and is not reconsidered; when a later word is missing the
    search restarts at the next token that fits the first word.
    """
    split = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda token: token != "")
    tokens = F.transform(split, lambda token: F.btrim(token, F.lit(_EDGE_MARKS)))
    cleaned = [word.lower().strip(_EDGE_MARKS) for word in words]

    def fits(token: Column, number: Column) -> Column:
        result = F.lit(False)
        for position, word in enumerate(cleaned):
            result = F.when(number == position, _wildcard(token, word)).otherwise(result)
        return result

    def found(all_tokens: Column) -> Column:
        def advance(at: Column, number: Column) -> Column:
            near = F.slice(all_tokens, at + 1, F.lit(slop + 1))
            step = F.array_position(F.transform(near, lambda token: fits(token, number)), True).cast("int")
            return F.when((at > 0) & (step > 0), at + step).otherwise(0)

        def from_start(position: Column) -> Column:
            start = F.when(fits(F.element_at(all_tokens, position), F.lit(0)), position).otherwise(0)
            rest = F.array(*map(F.lit, range(1, len(cleaned)))) if len(cleaned) > 1 else F.expr("array()").cast("array<int>")
            return F.aggregate(rest, start, advance) > 0

        return F.when(F.size(all_tokens) > 0, F.exists(F.sequence(F.lit(1), F.size(all_tokens)), from_start))

    return F.get(F.transform(F.array(tokens), found), 0)


class RecordPredicates:
    """Predicates over one kind of record."""

    def __init__(self, values: Callable[[str], list[JsonValue]], text: Callable[[], Column]):
        self._values = values
        self._text = text

    def _candidates(self, field: str | None) -> list[JsonValue]:
        return [JsonValue(self._text(), F.lit("STRING"))] if field is None else self._values(field)

    def _haystacks(self, field: str | None) -> list[Column]:
        return [value.text for value in self._candidates(field)]

    def field_is(self, field: str, pattern: str) -> Column:
        """Whole-value, case-insensitive glob; containment where the value is an object or array."""

        def matches(value: JsonValue) -> Column:
            whole = _like(value.text, pattern)
            return F.when(value.is_container, _like(value.text, f"*{pattern}*")).otherwise(whole)

        return any_of(truth(value.let(matches)) for value in self._values(field))

    def field_cmp(self, field: str, op: str, number: float | str) -> Column:
        """``> >= < <=`` where both sides are numbers, false everywhere else."""
        bound = parse_number(str(number))
        if bound is None or bound != bound:
            return F.lit(False)

        def holds(value: JsonValue) -> Column:
            left, right = value.comparable, F.lit(bound)
            result = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
            return result & ~F.isnan(left)

        return any_of(truth(value.let(holds)) for value in self._values(field))

    def has_text(self, term: str) -> Column:
        """Case-insensitive substring (or contained glob) of the whole record."""
        if "*" in term:
            return truth(_like(self._text(), f"*{term}*"))
        return truth(F.lower(self._text()).contains(F.lower(F.lit(term))))

    def term(self, text: str, field: str | None = None) -> Column:
        """Substring without wildcards; with ``*`` or ``?`` a glob over the whole value."""
        return any_of(truth(_wildcard(hay, text)) for hay in self._haystacks(field))

    def fuzzy(self, word: str, distance: int = DEFAULT_EDITS, field: str | None = None) -> Column:
        """Any word within an edit distance."""
        limit = at_least("the distance", distance, 0)
        wanted = word.lower()

        def near(hay: Column) -> Column:
            words = F.split(F.lower(hay), r"(?U)\s+")
            edits = lambda w: F.levenshtein(w, F.lit(wanted), limit)
            # Words whose length differs by more than the limit cannot match and skip the distance.
            fits = lambda w: F.length(w).between(max(len(wanted) - limit, 1), len(wanted) + limit)
            return truth(F.exists(words, lambda w: fits(w) & (edits(w) >= 0)))

        return any_of(near(hay) for hay in self._haystacks(field))

    def phrase(self, words: str | Iterable[str], slop: int = 0, field: str | None = None) -> Column:
        """Words in order; with no words it holds wherever the field has a value."""
        words = words.split() if isinstance(words, str) else list(words)
        haystacks = self._haystacks(field)
        if not words:
            return any_of(hay.isNotNull() for hay in haystacks)
        return any_of(truth(F.when(_holds_words(hay, words), _phrase_in_tokens(hay, words, slop))) for hay in haystacks)

    def between(
        self,
        low: str | float = "*",
        high: str | float = "*",
        include_low: bool = True,
        include_high: bool = True,
        field: str | None = None,
    ) -> Column:
        """Range with open ends (``*``): numeric where text and bound are numbers, else by bytes."""

        def side(text: Column, bound: str, inclusive: bool, upper: bool) -> Column:
            if bound == "*":
                return F.lit(True)

            def ordered(left: Column, right: Column) -> Column:
                if upper:
                    return left <= right if inclusive else left < right
                return left >= right if inclusive else left > right

            as_text = ordered(text, F.lit(bound))
            limit = parse_number(bound.strip())
            if limit is None:
                return as_text
            value = number_of(text, trim=True)
            # NaN compares equal to every number.
            unordered = F.isnan(value) | F.lit(limit != limit)
            numeric = F.when(unordered, F.lit(inclusive)).otherwise(ordered(value, F.lit(limit)))
            return F.when(value.isNotNull(), numeric).otherwise(as_text)

        def inside(value: JsonValue) -> Column:
            lower = side(value.text, str(low), include_low, False)
            return value.present & lower & side(value.text, str(high), include_high, True)

        return any_of(truth(value.let(inside)) for value in self._candidates(field))

    @staticmethod
    def bool_of(
        must: Iterable[Column] = (), should: Iterable[Column] = (), must_not: Iterable[Column] = ()
    ) -> Column:
        """Optional clauses are required only where nothing is mandatory."""
        must, should, must_not = list(must), list(should), list(must_not)
        result = all_of([*must, *(~clause for clause in must_not)])
        return result & any_of(should) if should and not must else result


logs = RecordPredicates(log_values, log_text)
spans = RecordPredicates(span_values, span_text)


def fuzzy_distance(similarity: float) -> int:
    """Edit distance for an old-style similarity between 0 and 1."""
    return 1 if similarity >= 0.8 else DEFAULT_EDITS
