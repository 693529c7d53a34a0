"""Lookups in JSON attribute text, with two-valued results and number parsing that ANSI mode cannot break."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number or a spelled-out infinity / NaN; no blanks, suffixes or hexadecimal forms.
NUMBER_PATTERN = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))"

# Characters that neither JSON path dialect can carry inside ['...'].
_UNSAFE_KEY = re.compile(r"['\"?\\]")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def truth(condition: Column) -> Column:
    """A predicate over a missing value is false, never unknown, so that negating it gives true."""
    return F.coalesce(condition, F.lit(False))


def number_of(text: Column, trim: bool = False) -> Column:
    """The text as a double, or NULL where it is not exactly a number."""
    blank = r"\s*" if trim else ""
    return F.when(text.rlike(rf"^{blank}{NUMBER_PATTERN}{blank}\z"), text.try_cast("double"))


def parse_number(text: str) -> float | None:
    """Driver-side twin of :func:`number_of` for literals."""
    return float(text) if re.fullmatch(NUMBER_PATTERN, text) else None


def number_text(value: float | int) -> str:
    """Shortest decimal text of a literal: whole numbers have no fraction."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def quote_json(text: Column) -> Column:
    """A JSON string literal for the text."""
    # The literal itself starts and ends with a quote, so only the array brackets are trimmed.
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def _path(keys: list[str]) -> str:
    return "$" + "".join(f"['{key}']" for key in keys)


@dataclass(frozen=True)
class JsonValue:
    """One value found in JSON text.

    ``text`` is NULL where the value is missing and ``'null'`` for a JSON null.  ``type_name`` is the
    VARIANT schema of the value (``STRING``, ``BOOLEAN``, ``OBJECT<...>``, ...), NULL where unknown.
    """

    text: Column
    type_name: Column
    numeric: Column | None = None
    # A plain table column; looked-up text is costly and must not be computed once per mention.
    simple: bool = False

    def let(self, use: Callable[[JsonValue], Column]) -> Column:
        """``use`` applied to this value with its text computed once.

        The text is bound to a lambda variable: inside conditional branches the engine would otherwise
        parse the document again at every mention.
        """
        if self.simple:
            return use(self)
        bound = F.transform(F.array(self.text), lambda t: use(replace(self, text=t, simple=True)))
        return F.get(bound, 0)

    @property
    def present(self) -> Column:
        return self.text.isNotNull()

    @property
    def is_container(self) -> Column:
        looks_nested = self.text.startswith("{") | self.text.startswith("[")
        return truth(F.when(looks_nested, self.type_name.rlike("^(OBJECT|ARRAY)")))

    @property
    def comparable(self) -> Column:
        """Numeric reading used by comparisons on fields: booleans are not numbers."""
        return number_of(self.text) if self.numeric is None else self.numeric

    @property
    def number(self) -> Column:
        """Numeric reading used by comparisons on spans: JSON booleans count as 1 and 0."""
        if self.numeric is not None:
            return self.numeric
        is_flag = self.text.isin("true", "false") & truth(self.type_name == "BOOLEAN")
        return F.when(is_flag, F.when(self.text == "true", 1.0).otherwise(0.0)).otherwise(number_of(self.text))


def plain(text: Column) -> JsonValue:
    """A table column seen as a value: always present, never nested."""
    return JsonValue(F.coalesce(text.cast("string"), F.lit("")), F.lit("STRING"), simple=True)


def plain_number(number: Column) -> JsonValue:
    """A numeric table column; comparisons read it without going through text."""
    return JsonValue(F.coalesce(number.cast("string"), F.lit("")), F.lit("STRING"), number.cast("double"), simple=True)


def body_value(body: Column, body_json: Column) -> JsonValue:
    """The log body, which may hold any JSON value."""
    nested = body_json.startswith("{") | body_json.startswith("[")
    return JsonValue(body, F.when(nested, F.lit("OBJECT")).otherwise(F.lit("STRING")), simple=True)


def _may_hold(document: Column, key: str) -> Column:
    """False only where the key cannot be in the document: its quoted name is missing, and any escape that might spell it."""
    return document.contains(f'"{key}"') | document.contains("\\")


def _text_at(document: Column, keys: list[str]) -> list[Column]:
    """Candidate texts of a path; documents without the last key are not parsed."""
    path, held = _path(keys), _may_hold(document, keys[-1])
    # Only a document that spells "null" can hold a JSON null, so the VARIANT parse is rarely reached.
    is_null = F.is_variant_null(F.try_variant_get(F.try_parse_json(document), path, "variant"))
    return [
        F.when(held, F.get_json_object(document, path)),
        F.when(held & document.contains("null"), F.when(is_null, F.lit("null"))),
    ]


def _text_at_any_key(document: Column, key: str) -> list[Column]:
    entries = F.from_json(document, "map<string,string>")
    return [F.try_element_at(entries, F.lit(key)), F.when(F.map_contains_key(entries, key), F.lit("null"))]


def _literal_texts(document: Column, key: str) -> list[Column]:
    return _text_at_any_key(document, key) if _UNSAFE_KEY.search(key) else _text_at(document, [key])


def literal_lookup(document: Column | str, key: str) -> Column:
    """Text of a top-level key, dots taken literally."""
    return F.coalesce(*_literal_texts(as_column(document), key))


def lookup(document: Column | str, key: str) -> JsonValue:
    """A key taken literally, else as a dotted path into nested objects; the literal key wins."""
    document = as_column(document)
    texts = _literal_texts(document, key)
    parts = key.split(".")
    if _UNSAFE_KEY.search(key):
        entries = F.from_json(document, "map<string,variant>")
        return JsonValue(F.coalesce(*texts), F.schema_of_variant(F.try_element_at(entries, F.lit(key))))
    variant = F.try_parse_json(document)
    variants = [F.try_variant_get(variant, _path([key]), "variant")]
    if len(parts) > 1 and all(parts):
        texts.extend(_text_at(document, parts))
        variants.append(F.try_variant_get(variant, _path(parts), "variant"))
    return JsonValue(F.coalesce(*texts), F.schema_of_variant(F.coalesce(*variants)))


def canonical(document: Column | str) -> Column:
    """JSON text with sorted keys, usable as a grouping key; text that is not JSON stays as it is."""
    document = as_column(document)
    return F.coalesce(F.to_json(F.try_parse_json(document)), document)
