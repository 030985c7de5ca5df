"""Compile ``field -> matcher`` conditions to Catalyst columns.

A condition is a dict of field matchers joined by AND. ``any_of`` adds a list of alternatives, ``not`` removes
rows. A matcher is a scalar (equality) or a dict of operators. Everything stays JVM-side, so simple terms reach
the Parquet scan and the rest is code-generated.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from nightjar.functions.net import is_private_ip
from nightjar.functions.text import first_label, shannon_entropy

RAW_PREFIX = "raw_field_"
LOW_PREFIX, PRIVATE_PREFIX = "low_field_", "private_field_"
LOWERED = ("eq", "neq", "in", "not_in", "contains", "startswith", "endswith")  # operators that read a field in lower case


def _low(value: Any) -> Any:
    return value.lower() if isinstance(value, str) else value


def _as_list(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def _all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


class Field:
    """One event field with the type knowledge the matchers need."""

    def __init__(self, column: Column, dtype: T.DataType, low: Column | None = None, private: Column | None = None):
        self.column = column
        self.low = low  # the field in lower case and whether it is a private address, if they stand in columns
        self.private = private
        self.is_text = isinstance(dtype, (T.StringType, T.VarcharType))
        self.is_array = isinstance(dtype, T.ArrayType)
        self.present = column.isNotNull()

    @property
    def text(self) -> Column:
        if self.is_array:
            return F.array_join(self.column, ", ")
        return self.column.cast("string")

    @property
    def lowered(self) -> Column:
        return self.lowered_text if self.is_text else self.column

    @property
    def lowered_text(self) -> Column:
        return F.lower(self.text) if self.low is None else self.low

    @property
    def private_ip(self) -> Column:
        return is_private_ip(self.text) if self.private is None else self.private

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.column.isNull()
        if self.is_array or self.is_text != isinstance(value, str):
            return F.lit(False)
        return F.coalesce(self.lowered == F.lit(_low(value)), F.lit(False))

    def is_in(self, values: list) -> Column:
        usable = [_low(v) for v in values if v is not None and self.is_text == isinstance(v, str)]
        found = F.coalesce(self.lowered.isin(usable), F.lit(False)) if usable and not self.is_array else F.lit(False)
        return found | self.column.isNull() if None in values else found


def _match(field: Field, op: str, arg: Any, max_chars: int | None) -> Column:
    present = field.present
    if op == "eq":
        return field.equals(arg)
    if op == "neq":
        return ~field.equals(arg)
    if op == "in":
        return field.is_in(list(arg))
    if op == "not_in":
        return present & ~field.is_in(list(arg))
    if op == "regex":
        text = F.substring(field.text, 1, max_chars) if max_chars else field.text
        return present & F.coalesce(text.rlike("(?uU)" + arg), F.lit(False))
    if op == "contains":
        return present & _any([F.coalesce(field.lowered_text.contains(str(_low(a))), F.lit(False)) for a in _as_list(arg)])
    if op == "startswith":
        return present & _any([F.coalesce(field.lowered_text.startswith(str(_low(a))), F.lit(False)) for a in _as_list(arg)])
    if op == "endswith":
        return present & _any([F.coalesce(field.lowered_text.endswith(str(_low(a))), F.lit(False)) for a in _as_list(arg)])
    if op in ("gte", "lte", "gt", "lt"):
        # text that is not a number leaves a null, which makes the whole rule silent for this event
        number = field.text.try_cast("double")
        bound = F.lit(float(arg))
        compare = {"gte": number >= bound, "lte": number <= bound, "gt": number > bound, "lt": number < bound}[op]
        return F.when(field.column.isNull(), False).otherwise(compare)
    if op == "exists":
        filled = present & F.coalesce(field.text != "", F.lit(False)) if field.is_text else present
        return filled if arg else ~filled
    if op == "private":
        return present & (field.private_ip if arg else ~field.private_ip)
    if op == "entropy_gte":
        return present & (F.coalesce(shannon_entropy(first_label(field.text)), F.lit(0.0)) >= float(arg))
    if op == "len_gte":
        return present & F.coalesce(F.length(field.text) >= int(arg), F.lit(False))
    raise ValueError(f"unknown condition operator: {op}")


def fields_of(spec: dict | None) -> set[str]:
    """All fields a condition reads."""
    found: set[str] = set()
    for key, value in (spec or {}).items():
        if key == "any_of":
            for inner in value:
                found |= fields_of(inner)
        elif key == "not":
            found |= fields_of(value)
        else:
            found.add(key)
    return found


def for_type(spec: dict | None, kind: str | None) -> dict | None:
    """What is left of a condition for events of a type (None: a type that no condition names); None if it can't hold for them.

    Only terms that are plainly true or false for the type go: ``event_type`` by itself, in a list, or inside ``any_of``.
    """
    left: dict[str, Any] = {}
    for key, value in (spec or {}).items():
        if key == "any_of":
            arms = [arm for arm in (for_type(inner, kind) for inner in value) if arm is not None]
            if not arms:
                return None
            left[key] = arms
        elif key == "event_type" and (named := _named_types(value)) is not None:
            if kind not in named:
                return None
        else:
            left[key] = value
    return left


def _named_types(matcher: Any) -> set[str] | None:
    """Event types, in lower case, that a matcher asks for; None if it is no equality with texts."""
    if isinstance(matcher, dict):
        if list(matcher) not in (["eq"], ["in"]):
            return None
        matcher = next(iter(matcher.values()))
    values = _as_list(matcher)
    return {v.lower() for v in values} if all(isinstance(v, str) for v in values) else None


def event_types_of(spec: dict | None) -> set[str]:
    """Event types that a condition names."""
    found: set[str] = set()
    for key, value in (spec or {}).items():
        if key == "any_of":
            found = found.union(*[event_types_of(inner) for inner in value])
        elif key == "event_type":
            found |= _named_types(value) or set()
    return found


def matchers_of(spec: dict | None) -> set[tuple[str, str]]:
    """All pairs of field and operator in a condition."""
    found: set[tuple[str, str]] = set()
    for key, value in (spec or {}).items():
        if key == "any_of":
            found = found.union(*[matchers_of(inner) for inner in value])
        elif key == "not":
            found |= matchers_of(value)
        else:
            found |= {(key, op) for op in (value if isinstance(value, dict) else ["eq"])}
    return found


def with_raw_fields(df: DataFrame, fields: set[str]) -> DataFrame:
    """Expose top-level values of ``raw`` for fields the event lacks (one variant look-up per field)."""
    if "raw" not in df.columns:
        return df
    is_variant = isinstance(df.schema["raw"].dataType, T.VariantType)
    raw = F.col("raw") if is_variant else F.try_parse_json(F.col("raw"))
    extra = {}
    for name in sorted(fields):
        path = "$['" + name.replace("'", "") + "']"
        value = F.try_variant_get(raw, path, "string")
        if name not in df.columns:
            extra[RAW_PREFIX + name] = value
        elif isinstance(df.schema[name].dataType, T.StringType):
            extra[RAW_PREFIX + name] = F.coalesce(F.col(name), value)
    return df.withColumns(extra) if extra else df


class ConditionCompiler:
    """Compiles conditions over one DataFrame; equal matchers of many rules share one column."""

    def __init__(self, df: DataFrame, max_chars: int | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.max_chars = max_chars
        self.fields: dict[str, Field] = {}
        self.terms: dict[tuple, Column] = {}

    def field(self, key: str) -> Field:
        if key not in self.fields:
            name = RAW_PREFIX + key if RAW_PREFIX + key in self.types else key
            known = name in self.types
            ready = [F.col(p + key) if p + key in self.types else None for p in (LOW_PREFIX, PRIVATE_PREFIX)]
            self.fields[key] = Field(F.col(name) if known else F.lit(None).cast("string"), self.types[name] if known else T.StringType(), *ready)
        return self.fields[key]

    def prepared(self, specs: list[dict | None]) -> dict[str, Column]:
        """Columns that the matchers of many conditions share: lower-case fields and address tests."""
        out: dict[str, Column] = {}
        for key, op in sorted(set().union(*[matchers_of(s) for s in specs])) if specs else []:
            field = self.field(key)
            if op in LOWERED and (field.is_text or op in ("contains", "startswith", "endswith")):
                out[LOW_PREFIX + key] = field.lowered_text
            elif op == "private":
                out[PRIVATE_PREFIX + key] = field.private_ip
        return out

    def term(self, key: str, op: str, arg: Any) -> Column:
        """Column of one matcher. ``max_chars`` bounds what a regular expression sees."""
        mark = (key, op, repr(arg))
        if mark not in self.terms:
            self.terms[mark] = _match(self.field(key), op, arg, self.max_chars)
        return self.terms[mark]

    def compile(self, spec: dict | None) -> Column:
        terms: list[Column] = []
        for key, value in (spec or {}).items():
            if key == "any_of":
                terms.append(_any([self.compile(inner) for inner in value]))
            elif key == "not":
                terms.append(~self.compile(value))
            else:
                checks = value.items() if isinstance(value, dict) else [("eq", value)]
                terms += [self.term(key, op, arg) for op, arg in checks]
        return _all(terms)

    def holds(self, spec: dict | None) -> Column:
        """The condition with errors folded to false."""
        return F.coalesce(self.compile(spec), F.lit(False))


def compile_condition(df: DataFrame, spec: dict | None, max_chars: int | None = None) -> Column:
    """Boolean column for a condition over ``df``; unknown fields behave as missing values.

    By default regular expressions search the whole text.
    """
    return ConditionCompiler(df, max_chars).compile(spec)


def holds(df: DataFrame, spec: dict | None, max_chars: int | None = None) -> Column:
    return ConditionCompiler(df, max_chars).holds(spec)
