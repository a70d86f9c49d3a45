"""Element paths as Columns: `Observation.code.coding.where(system = 'loinc').code`, `value.ofType(Quantity).unit`, `x.exists()`.

A path is a row of steps over a record with a known struct type. It is compiled once, on the driver, to transform, filter and
flatten over that type; nothing is interpreted in tasks. Steps are names (a choice `value[x]` is called `value` and stands for all its
typed fields), where(condition), ofType(Type), exists() and resolve(). Conditions compare paths below the value at hand ($this is
the value itself) with literals by =, test them by exists(), ofType(Type) and conformsTo('profile'), and join tests by `and` (first)
and `or`. A comparison holds if any of the values is equal.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions import lookup

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+(?:\.\d+)?)|(\$?[A-Za-z_][\w-]*)|([.()=]))")


@dataclass(frozen=True)
class Step:
    """A name, or a function with its condition, type or profile."""

    name: str
    call: bool = False
    argument: object = None


@dataclass(frozen=True)
class Test:
    """A path and what it must be equal to; without that it must have a value. Tests in `parts` are joined by `join`."""

    steps: tuple[Step, ...] = ()
    literal: str | None = None
    join: str | None = None
    parts: tuple[Test, ...] = ()


@dataclass
class _Reader:
    text: str
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        place = 0
        while self.text[place:].strip():
            m = _TOKEN.match(self.text, place)
            if not m:
                raise ValueError(f"{self.text!r} is no path at {self.text[place:]!r}")
            kind = next(k for k, g in zip(("text", "number", "name", "mark"), m.groups(), strict=True) if g is not None)
            self.tokens.append((kind, m.group(m.lastindex)))
            place = m.end()

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("mark", "name") and self.tokens[self.at][1] in values

    def take(self, kind: str, *values: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or values and self.tokens[self.at][1] not in values:
            raise ValueError(f"{self.text!r}: {' or '.join(values) or kind} expected at {' '.join(t for _, t in self.tokens[self.at :]) or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def steps(self) -> tuple[Step, ...]:
        out = []
        while True:
            if self.next_is("and", "or"):
                raise ValueError(f"{self.text!r}: a name is expected before {self.tokens[self.at][1]}")
            name = self.take("name")
            if not self.next_is("("):
                out.append(Step(name))
            else:
                self.take("mark", "(")
                argument: object = None
                if name == "where":
                    argument = self.either()
                elif name == "ofType":
                    argument = self.take("name")
                elif name == "conformsTo":
                    argument = _plain(self.take("text"))
                elif name not in ("exists", "resolve"):
                    raise ValueError(f"{self.text!r}: {name}() is not known")
                self.take("mark", ")")
                out.append(Step(name, True, argument))
            if not self.next_is("."):
                return tuple(out)
            self.take("mark", ".")

    def either(self) -> Test:
        return self._joined("or", lambda: self._joined("and", self.test))

    def _joined(self, word: str, part) -> Test:
        parts = [part()]
        while self.next_is(word):
            self.at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else Test(join=word, parts=tuple(parts))

    def test(self) -> Test:
        if self.next_is("("):
            self.take("mark", "(")
            inner = self.either()
            self.take("mark", ")")
            return inner
        steps = self.steps()
        if not self.next_is("="):
            return Test(steps)
        self.take("mark", "=")
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind not in ("text", "number") and value not in ("true", "false"):
            raise ValueError(f"{self.text!r}: a literal is expected after =")
        self.at += 1
        return Test(steps, _plain(value) if kind == "text" else value)


def _plain(quoted: str) -> str:
    return re.sub(r"\\(.)", r"\1", quoted[1:-1])


def quoted(text: str) -> str:
    """A text as a literal of a path."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@functools.lru_cache(maxsize=4096)
def parse(text: str) -> tuple[Step, ...]:
    """The steps of a path; ValueError where it is none."""
    reader = _Reader(text)
    out = reader.steps()
    if reader.at < len(reader.tokens):
        raise ValueError(f"{text!r}: {reader.tokens[reader.at][1]!r} is left over")
    return out


@dataclass(frozen=True)
class Values:
    """What a path has led to so far: a value, or many in an array, of one type. choice is the type's name in a choice of types."""

    column: Column
    kind: T.DataType
    many: bool = False
    choice: str | None = None

    def present(self) -> Column:
        if self.many:
            return F.coalesce(F.exists(self.column, lambda x: x.isNotNull()), F.lit(False))
        return self.column.isNotNull()

    def any(self, test) -> Column:
        if self.many:
            return F.coalesce(F.exists(self.column, test), F.lit(False))
        return F.coalesce(test(self.column), F.lit(False))


def _spread(column: Column, kind: T.DataType, choice: str | None = None) -> Values:
    """A field's value; of a list each of its values."""
    return Values(column, kind.elementType, True, choice) if isinstance(kind, T.ArrayType) else Values(column, kind, False, choice)


def _each(column: Column, name: str) -> Column:
    """A field of each value, where there is one."""
    return F.filter(F.transform(column, lambda x: x[name]), lambda x: x.isNotNull())


def _kept(v: Values, test: Callable[[Column], Column]) -> Column:
    """The values that pass a test."""
    if v.many:
        return F.filter(v.column, lambda x: F.coalesce(test(x), F.lit(False)))
    return F.when(F.coalesce(test(v.column), F.lit(False)), v.column)


def _field(v: Values, name: str) -> list[Values]:
    if not isinstance(v.kind, T.StructType):
        return []
    fields = {f.name: f.dataType for f in v.kind.fields}
    chosen = [(name, None)] if name in fields else [(f, f[len(name) :]) for f in fields if f.startswith(name) and f[len(name) : len(name) + 1].isupper()]
    out = []
    for f, choice in chosen:
        if not v.many:
            out.append(_spread(v.column[f], fields[f], choice))
        elif isinstance(fields[f], T.ArrayType):
            out.append(Values(F.flatten(_each(v.column, f)), fields[f].elementType, True, choice))
        else:
            out.append(Values(_each(v.column, f), fields[f], True, choice))
    return out


def _after(found: Sequence[Values], step: Step, conforms: Column | None) -> list[Values]:
    if not step.call:
        return [x for v in found for x in ([v] if step.name == "$this" else _field(v, step.name))]
    if step.name == "resolve":  # a reference stands for its target
        return [x for v in found for x in (_field(v, "reference") if isinstance(v.kind, T.StructType) else [v])]
    if step.name == "ofType":
        # the types of what is no choice are those of the schema, so nothing is left to tell apart
        return [v for v in found if v.choice is None or v.choice.lower() == str(step.argument).lower()]
    if step.name == "where":
        return [Values(_kept(v, functools.partial(_holds, step.argument, kind=v.kind, conforms=conforms)), v.kind, v.many, v.choice) for v in found]
    if step.name == "conformsTo":
        claims = (lambda x: F.array_contains(lookup.value_of(conforms, x.cast("string")), str(step.argument))) if conforms is not None else (lambda x: F.lit(False))
        return [Values(_kept(v, claims), v.kind, v.many, v.choice) for v in found]
    raise ValueError(f"{step.name}() does not lead to values")


def _holds(test: Test, value: Column, kind: T.DataType, conforms: Column | None) -> Column:
    if test.join:
        parts = [_holds(t, value, kind, conforms) for t in test.parts]
        return functools.reduce(lambda a, b: a & b if test.join == "and" else a | b, parts)
    steps = test.steps[:-1] if test.steps[-1].call and test.steps[-1].name == "exists" else test.steps
    found = [Values(value, kind)]
    for step in steps:
        found = _after(found, step, conforms)
    if test.literal is None:
        checks = [v.present() for v in found]
    else:
        checks = [v.any(lambda x: x.cast("string") == F.lit(test.literal)) for v in found if not isinstance(v.kind, (T.StructType, T.ArrayType))]
    return functools.reduce(lambda a, b: a | b, checks, F.lit(False))


def holds(condition: str, value: Column, kind: T.DataType, conforms: Column | None = None) -> Column:
    """A condition, as in where(...), of one value."""
    return F.coalesce(_holds(parse(f"where({condition})")[0].argument, value, kind, conforms), F.lit(False))


def select(path: str, record: Column, kind: T.StructType, conforms: Column | None = None) -> list[Values]:
    """What a path leads to in a record of a type: one entry for each type that it can have, none where the type has no such element.

    A path may begin with the record's own type. conforms maps references, ascending, to the profiles of their targets.
    """
    steps = parse(path)
    if steps[0].name[:1].isupper() and not steps[0].call and steps[0].name not in kind.fieldNames():
        steps = steps[1:]
    found = [Values(record, kind)]
    for step in steps:
        if step.call and step.name == "exists":
            break
        found = _after(found, step, conforms)
    return found


def values(path: str, record: Column, kind: T.StructType, conforms: Column | None = None) -> Column:
    """The values of a path as an array of texts (structs as JSON), in their order, without nulls."""
    parts = [F.array().cast("array<string>")]
    for v in select(path, record, kind, conforms):
        text = (lambda x: F.to_json(x)) if isinstance(v.kind, (T.StructType, T.ArrayType)) else (lambda x: x.cast("string"))
        one = F.filter(F.transform(v.column, text), lambda x: x.isNotNull()) if v.many else F.array_compact(F.array(text(v.column)))
        parts.append(F.coalesce(one, F.array().cast("array<string>")))
    return F.concat(*parts)


def has_value(path: str, record: Column, kind: T.StructType, conforms: Column | None = None) -> Column:
    """Whether a path leads to any value."""
    return functools.reduce(lambda a, b: a | b, [v.present() for v in select(path, record, kind, conforms)], F.lit(False))
