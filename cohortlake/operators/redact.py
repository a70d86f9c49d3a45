"""Copying and redacting nested records by their groups' attributes and profiles, compiled to Columns.

A profile is a list of Elements (what sources.readers.profile_elements reads). Plans are made on the driver from these small
lists and the struct schema of a record type; what runs is one expression a record type and set of groups.

Copying keeps the selected elements; a step `name:slice` keeps those values of a list that match the slice. Redaction then
walks the copy with the contexts of all profiles at once: a value of a sliced list that matches no slice is emptied (and
marked if the element is required), extensions that no profile slices go, references to records that were not extracted are
replaced by a marker, and what a profile requires but is not there is marked. The marker is an extension of ABSENT_URL.

Which slices a value matches is worked out once and carried beside it; what depends on a slice is compiled once, under that
condition, so expressions grow with the number of slices and profiles, not with their combinations.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions import lookup, paths

#: The extensions that say why a value is absent, and the code of what may not be shown.
ABSENT_URL = "http://hl7.org/fhir/StructureDefinition/data-absent-reason"
ABSENT_URLS = (ABSENT_URL, "http://terminology.hl7.org/CodeSystem/data-absent-reason")
MASKED = "masked"
#: Fixed value: this list may be sliced, but is shown whole.
UNSLICED = "Patient.identifier"

_MARK_TYPE = T.StructType([T.StructField("url", T.StringType()), T.StructField("valueCode", T.StringType())])
_STUB = T.StructType([T.StructField("extension", T.ArrayType(_MARK_TYPE))])


@dataclass(frozen=True)
class Element:
    """One element of a profile. pattern is its fixed value or pattern as JSON text."""

    element_id: str
    path: str
    slice_name: str | None = None
    min: int = 0
    types: tuple[str, ...] = ()
    type_profiles: tuple[str, ...] = ()
    target_profiles: tuple[str, ...] = ()
    discriminators: tuple[tuple[str, str], ...] | None = None
    pattern: str | None = None
    bound: bool = False
    max: str | None = None


@dataclass
class Profile:
    """The elements of a profile by id, and the slices of each path."""

    url: str
    elements: Sequence[Element]
    by_id: dict[str, Element] = field(init=False)

    def __post_init__(self) -> None:
        self.by_id = {e.element_id: e for e in self.elements}

    def sliced(self, element_id: str) -> bool:
        found = self.by_id.get(element_id)
        return found is not None and found.discriminators is not None

    def slices(self, element_id: str) -> list[Element]:
        """The slices of an element, in order; those of its slices' own slices (`a:b/c`) among them."""
        found = self.by_id.get(element_id)
        if found is None or found.discriminators is None:
            return []
        return [e for e in self.elements if e.path == found.path and e.slice_name and e.element_id.startswith(element_id + ":")]


def profile_of(url: str, rows: Sequence) -> Profile:
    """A Profile from collected rows of profile_elements of one url."""
    make = lambda r: Element(
        r["element_id"], r["path"], r["slice_name"], r["min"] or 0, tuple(r["types"] or ()), tuple(r["type_profiles"] or ()), tuple(r["target_profiles"] or ()) if "target_profiles" in r else (),
        tuple((d["type"].upper(), d["path"]) for d in r["discriminators"]) if r["discriminators"] is not None else None, r["pattern"], bool(r["bound"]), r["max"] if "max" in r else None,
    )
    return Profile(url, [make(r) for r in rows])


# --- matching --------------------------------------------------------------------------------------------------------


def _struct(kind: T.DataType) -> T.StructType | None:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind if isinstance(kind, T.StructType) else None


def holds_pattern(value: Column, kind: T.DataType, pattern) -> Column:
    """Whether a value has everything that a fixed value or pattern has; one value of a list is enough, and of a pattern's
    list the first counts.
    """
    if isinstance(pattern, list):
        return holds_pattern(value, kind, pattern[0]) if pattern else F.lit(True)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: holds_pattern(x, kind.elementType, pattern)), F.lit(False))
    if isinstance(pattern, dict):
        names = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        out = F.lit(True)
        for name, part in pattern.items():
            out &= holds_pattern(value[name], names[name], part) if name in names else F.lit(False)
        return out
    if isinstance(kind, T.StructType):
        return F.lit(False)
    wanted = str(pattern).lower() if isinstance(pattern, bool) else str(pattern)
    return F.coalesce(value.cast("string") == F.lit(wanted), F.lit(False))


def _at(value: Column, kind: T.DataType, steps: Sequence[str], pattern) -> Column:
    """holds_pattern of what lies `steps` below value."""
    if not steps:
        return holds_pattern(value, kind, pattern)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: _at(x, kind.elementType, steps, pattern)), F.lit(False))
    found = next((f for f in kind.fields if f.name == steps[0]), None) if isinstance(kind, T.StructType) else None
    return _at(value[found.name], found.dataType, steps[1:], pattern) if found else F.lit(False)


def _any(tests: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def _both(a: Column | None, b: Column | None) -> Column | None:
    """Both conditions; None is one that always holds."""
    return b if a is None else a if b is None else a & b


def _of_types(value: Column, kind: T.DataType, path: str, types: Sequence[str]) -> Column:
    """Whether something of one of the types lies at a path below a value."""
    wanted = [t.lower() for t in types]
    return _any([v.present() for v in paths.select(path, value, kind) if v.choice is None or v.choice.lower() in wanted])


def matches_slice(profile: Profile, sliced: Element, own: Element, value: Column, kind: T.DataType, type_name: str | None = None) -> Column:
    """Whether one value belongs to a slice: all discriminators of the sliced element hold.

    VALUE and PATTERN compare with the fixed value or pattern at the discriminator's path, or nearest above it; one that is
    bound to a value set only counts as matched. TYPE compares the type of the value (type_name), or of what lies at the path. Other
    kinds match nothing here; copying knows them (slice_conditions).
    """
    out = F.lit(True)
    for kind_of, path in sliced.discriminators or ():
        steps = [] if path in ("$this", "") else path.split(".")
        if path == "url" and kind_of == "VALUE" and own.types[:1] == ("Extension",) and own.type_profiles:
            out &= F.coalesce(value["url"].isin(list(own.type_profiles)), F.lit(False))
        elif kind_of in ("VALUE", "PATTERN"):
            test, bound = None, False
            for n in range(len(steps), -1, -1):
                found = profile.by_id.get(".".join([own.element_id, *steps[:n]]))
                if found is not None and found.pattern is not None:
                    rest, pattern = steps[n:], json.loads(found.pattern)
                    for step in rest:
                        pattern = pattern[0] if isinstance(pattern, list) and pattern else pattern
                        pattern = pattern.get(step) if isinstance(pattern, dict) else None
                    test = _at(value, kind, steps, pattern) if pattern is not None else F.lit(False)
                    break
                bound |= found is not None and found.bound
            out &= test if test is not None else F.lit(bound)
        elif kind_of == "TYPE" and not steps:
            out &= F.lit(type_name is not None and type_name.lower() in [t.lower() for t in own.types])
        elif kind_of == "TYPE" and "resolve()" not in path and (typed := _child(profile, own, path)) is not None:
            out &= _of_types(value, kind, path, typed.types)
        else:
            return F.lit(False)
    return out


def _child(profile: Profile, own: Element, path: str) -> Element | None:
    """The element of a profile at a path below another; a choice's is called `name[x]`."""
    return next((e for e in (profile.by_id.get(f"{own.element_id}.{path}{end}") for end in ("", "[x]")) if e is not None), None)


def asks_targets(profile: Profile, element_ids: Sequence[str]) -> bool:
    """Whether a selected slice is told apart by the profiles of the targets of references."""
    ids = [".".join(i.split(".")[: n + 1]) for i in element_ids for n, step in enumerate(i.split(".")) if ":" in step]
    return any(found and any(kind == "PROFILE" for kind, _ in found[0].discriminators or ()) for found in (_slice_of(profile, i) for i in ids))


def _pattern_conditions(at: str, pattern) -> list[str]:
    """A fixed value or pattern as conditions of a path, one for each primitive in it."""
    if isinstance(pattern, dict):
        return [c for name, part in pattern.items() for c in _pattern_conditions(f"{at}.{name}", part)]
    if isinstance(pattern, list):
        return [c for part in pattern for c in _pattern_conditions(at, part)]
    text = str(pattern).lower() if isinstance(pattern, bool) else str(pattern)
    return [f"{at} = {paths.quoted(text)}"]


def slice_conditions(profile: Profile, sliced: Element, own: Element, type_name: str | None = None) -> list[str] | None:
    """The discriminators of a slice as conditions of a path, all of which hold for its values; None if no value can match.

    EXISTS asks for a value at the path, TYPE for one of the slice's types there, PROFILE for a reference whose target claims one
    of the slice's target profiles. A discriminator of which the profile says nothing below the slice adds no condition.
    """
    out = []
    for kind, path in sliced.discriminators or ():
        at = "$this" if path in ("$this", "") else path
        if kind in ("VALUE", "PATTERN"):
            found = own if at == "$this" else _child(profile, own, path)
            if path == "url" and own.types[:1] == ("Extension",) and found is None:
                out += [" or ".join(f"url = {paths.quoted(u)}" for u in own.type_profiles)] if own.type_profiles else []
            elif found is not None and found.pattern is not None:
                out += _pattern_conditions(at, json.loads(found.pattern))
        elif kind == "EXISTS":
            out.append(f"{at}.exists()")
        elif kind == "TYPE":
            typed = own if at == "$this" else _child(profile, own, path)
            if at == "$this" and type_name is not None:
                if type_name.lower() not in [t.lower() for t in own.types]:
                    return None
            elif typed is not None and typed.types:
                out.append(" or ".join(f"{at}.ofType({t})" for t in typed.types))
        elif kind == "PROFILE" and own.target_profiles:
            target = at if at.endswith("resolve()") else f"{at}.resolve()"
            out.append(" or ".join(f"{target}.conformsTo({paths.quoted(u)})" for u in own.target_profiles))
    return [f"({c})" if " or " in c else c for c in out]


def _slice_of(profile: Profile, element_id: str) -> tuple[Element, Element] | None:
    """The sliced element and the slice that an element id `a.b:s` stands for."""
    base, _, _ = element_id.rpartition(":")
    plain = ".".join(s.partition(":")[0] for s in base.split("."))
    sliced = next((profile.by_id[b] for b in (base, plain) if profile.sliced(b)), None)
    own = next((profile.by_id[i] for i in (element_id, f"{plain}:{element_id.rpartition(':')[2]}") if i in profile.by_id), None)
    return (sliced, own) if sliced is not None and own is not None else None


def path_of(element_id: str, profile: Profile) -> str:
    """The path of an element id: `A.b:s.value[x]:valueQuantity` gives `A.b.where(...).value.ofType(Quantity)`.

    ValueError where a slice is not in the profile.
    """
    out, steps = [], element_id.split(".")
    for n, step in enumerate(steps):
        name, slice_name = _split(step)
        plain = name.removesuffix("[x]")
        if name.endswith("[x]"):
            out.append(f"{plain}.ofType({slice_name.removeprefix(plain)})" if slice_name else plain)
        elif slice_name:
            found = _slice_of(profile, ".".join(steps[: n + 1]))
            if found is None:
                raise ValueError(f"{profile.url} has no slice {'.'.join(steps[: n + 1])}")
            conditions = slice_conditions(profile, *found)
            out.append(f"{name}.where({' and '.join(conditions)})" if conditions else name)
        else:
            out.append(name)
    return ".".join(out)


# --- copying ---------------------------------------------------------------------------------------------------------


def _split(step: str) -> tuple[str, str | None]:
    name, _, slice_name = step.partition(":")
    return name, slice_name or None


def copy_tree(element_ids: Sequence[str]) -> dict:
    """{name: {slice or None: subtree}}: a path below another selected one adds nothing, and one under a condition adds
    nothing where the same list is selected whole.
    """
    tree: dict = {}
    for path in sorted(set(element_ids), key=lambda p: (p.count("."), ":" in p)):
        steps = [_split(s) for s in path.split(".")[1:]]
        node = tree
        for i, (name, slice_name) in enumerate(steps):
            entry = node.setdefault(name, {})
            if None in entry and not entry[None]:
                break
            if slice_name in entry and not entry[slice_name]:
                break
            node = entry.setdefault(slice_name, {})
            if i == len(steps) - 1:
                node.clear()
                if slice_name is None:
                    entry.clear()
                    entry[None] = {}
    return tree


def _united(trees: Sequence[dict]) -> dict:
    """The union of subtrees; an empty one is a whole subtree."""
    if any(not t for t in trees):
        return {}
    out: dict = {}
    for name in {n: None for t in trees for n in t}:
        entries = [t[name] for t in trees if name in t]
        keys = {k: None for e in entries for k in e}
        united = {k: _united([e[k] for e in entries if k in e]) for k in keys}
        out[name] = {None: {}} if None in united and not united[None] else united
    return out


def _fields(kind: T.StructType, name: str) -> list[T.StructField]:
    """The fields that an element name stands for: itself, or all types of a choice (`value[x]`)."""
    if name.endswith("[x]"):
        stem = name[:-3]
        return [f for f in kind.fields if f.name.startswith(stem) and f.name[len(stem) : len(stem) + 1].isupper()]
    return [f for f in kind.fields if f.name == name]


#: Subtrees with the condition under which they are taken (None: always) and the element id that they stand below.
Trees = list[tuple[Column | None, str, dict]]


def _resolved(kind: T.StructType, trees: Trees) -> dict[str, list[tuple[Column | None, str, str | None, dict]]]:
    """For each field the (condition, element id of the name, slice, subtree) that select it; a choice's slice may be one of its fields."""
    out: dict[str, list] = {}
    for condition, at, tree in trees:
        for name, entry in tree.items():
            for slice_name, sub in entry.items():
                fields = _fields(kind, name)
                typed = [f for f in fields if f.name == slice_name]
                for f in typed or fields:
                    out.setdefault(f.name, []).append((condition, f"{at}.{name}", None if typed else slice_name, sub))
    return out


def copied(value: Column, kind: T.DataType, trees: Trees, profiles: Sequence[Profile], conforms: Column | None = None) -> Column:
    """Value with the selected elements only: lists keep their grouping, empty parts are left out."""
    whole = [c for c, _, tree in trees if not tree]
    if any(c is None for c in whole):
        return value
    if isinstance(kind, T.ArrayType):
        out = F.filter(F.transform(value, lambda x: copied(x, kind.elementType, trees, profiles, conforms)), lambda x: x.isNotNull())
        return F.when(F.size(out) > 0, out)
    if not isinstance(kind, T.StructType):
        return value if any(c is None for c, _, _ in trees) else F.when(_any([c for c, _, _ in trees]), value)
    chosen = _resolved(kind, [t for t in trees if t[2]])
    parts = {f.name: _copied_field(value[f.name], f, chosen[f.name], profiles, conforms) for f in kind.fields if f.name in chosen}
    part = F.when(_any([p.isNotNull() for p in parts.values()]), _built(kind, parts)) if parts else F.lit(None).cast(kind)
    return F.when(_any(whole), value).otherwise(part) if whole else part


def _copied_field(value: Column, f: T.StructField, entries: list[tuple[Column | None, str, str | None, dict]], profiles: Sequence[Profile], conforms: Column | None) -> Column:
    always: Trees = [(c, at, sub) for c, at, s, sub in entries if s is None]
    under = [e for e in entries if e[2] is not None]
    if not under or any(c is None and not sub for c, _, sub in always):
        return copied(value, f.dataType, always, profiles, conforms)
    listed = isinstance(f.dataType, T.ArrayType)
    kind = f.dataType.elementType if listed else f.dataType

    def tests(x: Column) -> list[Column]:
        out = []
        for _, at, s, _ in under:
            found = [(p, *own) for p in profiles if (own := _slice_of(p, f"{at}:{s}"))]
            ways = [slice_conditions(p, sliced, own, _type_name(f.name, at, sliced)) for p, sliced, own in found]
            out.append(_any([paths.holds(" and ".join(w), x, kind, conforms) if w else F.lit(True) for w in ways if w is not None]))
        return out

    def one(x: Column) -> Column:
        trees = [*always, *((_both(c, x["m"][i]), f"{at}:{s}", sub) for i, (c, at, s, sub) in enumerate(under))]
        return copied(x["v"], kind, trees, profiles, conforms)

    tagged = F.transform(value if listed else F.array(value), lambda x: F.struct(x.alias("v"), F.array(*tests(x)).alias("m")))
    out = F.filter(F.transform(tagged, one), lambda x: x.isNotNull())
    return F.when(F.size(out) > 0, out if listed else out[0])


def _type_name(field_name: str, at: str, base: Element) -> str | None:
    """The type of a value: what its field adds to a choice's name, or the only type that its element has."""
    name = at.rsplit(".", 1)[-1].partition(":")[0]
    if name.endswith("[x]"):
        return field_name[len(name) - 3 :]
    return base.types[0] if len(base.types) == 1 else None


# --- redaction -------------------------------------------------------------------------------------------------------


def marked_type(kind: T.DataType) -> T.DataType:
    """The schema of a redacted value: every struct can hold extensions, every primitive `x` has a `_x` that holds them."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(marked_type(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    names, out = {f.name for f in kind.fields}, []
    for f in kind.fields:
        if f.name == "extension":
            own = _struct(f.dataType)
            more = [m for m in _MARK_TYPE.fields if m.name not in {x.name for x in own.fields}]
            out.append(T.StructField("extension", T.ArrayType(marked_type(T.StructType([*own.fields, *more])))))
            continue
        out.append(T.StructField(f.name, marked_type(f.dataType)))
        if not isinstance(f.dataType, (T.StructType, T.ArrayType)) and f"_{f.name}" not in names and f.name != "url":
            out.append(T.StructField(f"_{f.name}", _STUB))
    if "extension" not in names and "url" not in names:
        out.append(T.StructField("extension", T.ArrayType(_MARK_TYPE)))
    return T.StructType(out)


def _mark() -> Column:
    return F.struct(F.lit(ABSENT_URL).alias("url"), F.lit(MASKED).alias("valueCode"))


def _marks(kind: T.DataType) -> Column:
    """A list with the marker, as the extension field's own type."""
    own = _struct(kind)
    return F.array(F.struct(*({"url": F.lit(ABSENT_URL), "valueCode": F.lit(MASKED)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in own.fields)))


def _optional(kind: T.DataType) -> T.DataType:
    """A type that lets everything in it be missing."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_optional(kind.elementType))
    return T.StructType([T.StructField(f.name, _optional(f.dataType)) for f in kind.fields]) if isinstance(kind, T.StructType) else kind


def _built(kind: T.StructType, parts: dict[str, Column]) -> Column:
    """A struct of a type from some of its fields."""
    return F.struct(*(parts.get(f.name, F.lit(None)).cast(_optional(f.dataType)).alias(f.name) for f in kind.fields))


#: Profiles with the element that they are at, and the condition under which they are (None: always).
Context = list[tuple[Profile, str, Column | None]]


def _descended(context: Context, name: str) -> Context:
    """Contexts of a child field; a field of a choice stands for the choice where the profile has that."""
    out = []
    for p, at, when in context:
        direct = f"{at}.{name}"
        if direct not in p.by_id:
            for n in range(len(name) - 1, 0, -1):
                if name[n].isupper() and f"{at}.{name[:n]}[x]" in p.by_id:
                    typed = f"{at}.{name[:n]}[x]:{name}"
                    direct = typed if typed in p.by_id else f"{at}.{name[:n]}[x]"
                    break
        out.append((p, direct, when))
    return out


def _known(context: Context) -> list[Element]:
    return [p.by_id[at] for p, at, _ in context if at in p.by_id]


def _holding(whens: Sequence[Column | None]) -> Column | None:
    """Whether one of several conditions holds; None if there is none."""
    if not whens:
        return None
    return F.lit(True) if any(w is None for w in whens) else _any(whens)


def _needed(context: Context) -> Column | None:
    """When an element is required; None if it never is."""
    return _holding([when for p, at, when in context if at in p.by_id and p.by_id[at].min > 0])


def _allowed(ref: Column, refs: Column, context: Context) -> Column:
    """Whether refs (attribute id to ascending list of references) allows ref for an element at or below the attribute."""
    ids: dict[str, list] = {}
    for _, at, when in context:
        ids.setdefault(at, []).append(when)

    def below(key: Column) -> Column:
        ends = lambda i: F.lit(i).startswith(key) & F.substring(F.lit(i), F.length(key) + 1, F.lit(1)).isin("", ".", ":", "[")
        return _any([ends(i) & _holding(whens) for i, whens in sorted(ids.items())])

    return F.coalesce(F.exists(F.map_entries(refs), lambda e: below(e["key"]) & lookup.contains(e["value"], ref)), F.lit(False))


def _stub(kind: T.DataType, context: Context, refs: Column) -> Column:
    """The marker in place of a missing value; a backbone's required children are marked as well."""
    if isinstance(kind, T.ArrayType):
        return F.array(_stub(kind.elementType, context, refs))
    out = marked_type(kind)
    if not isinstance(kind, T.StructType):
        return F.lit(None).cast(out)
    marks = _marks(next(f.dataType for f in out.fields if f.name == "extension")) if "extension" in out.fieldNames() else None
    first = next((t for e in _known(context) for t in e.types), None)
    if first != "BackboneElement":
        return _built(out, {"extension": marks} if marks is not None else {})
    return _children(F.lit(None).cast(kind), kind, context, refs, marks)


def _children(value: Column, kind: T.StructType, context: Context, refs: Column, marks: Column | None = None) -> Column:
    """A struct with all its children redacted; marks, where given, are its own extensions."""
    out, parts = marked_type(kind), {}
    choices: dict[str, list[T.StructField]] = {}
    for f in kind.fields:
        if f.name == "extension":
            parts["extension"] = _extensions(value["extension"], f.dataType, _descended(context, "extension"), refs)
            continue
        below = _descended(context, f.name)
        own, needed = value[f.name], _needed(below)
        for _, at, _ in below:
            if "[x]" in at.rsplit(".", 1)[1]:
                choices.setdefault(at.split("[x]")[0].rsplit(".", 1)[1], []).append(f)
                break
        inner = _struct(f.dataType)
        stem_choice = any("[x]" in at.rsplit(".", 1)[1] for _, at, _ in below)
        if inner is None:
            parts[f.name] = own
            if needed is not None and not stem_choice and not isinstance(f.dataType, T.ArrayType) and f"_{f.name}" in out.fieldNames() and f"_{f.name}" not in kind.fieldNames():
                parts[f"_{f.name}"] = F.when(own.isNull() & needed, F.struct(F.array(_mark()).alias("extension")))
            continue
        done = _values(own, f.dataType, below, refs, f.name)
        empty = own.isNull() | (F.size(own) <= 0) if isinstance(f.dataType, T.ArrayType) else own.isNull()
        parts[f.name] = F.when(~empty, done)
        if needed is not None and not stem_choice:
            parts[f.name] = F.when(empty, F.when(needed, _stub(f.dataType, below, refs))).otherwise(done)
    for fields in choices.values():  # one of a required choice: the first type the profile names, or the first field
        below = _descended(context, fields[0].name)
        bare = [(p, at.split(":")[0] if "[x]:" in at else at, when) for p, at, when in below]
        needed = _needed(bare)
        if needed is None:
            continue
        none = needed & value[fields[0].name].isNull()
        for f in fields[1:]:
            none &= value[f.name].isNull()
        wanted = [t.lower() for e in _known(bare) for t in e.types]
        stem = bare[0][1].rsplit(".", 1)[1][:-3]
        first = next((f for t in wanted for f in fields if f.name[len(stem) :].lower() == t), fields[0])
        if _struct(first.dataType) is None:
            parts[f"_{first.name}"] = F.when(none, F.struct(F.array(_mark()).alias("extension")))
        else:
            parts[first.name] = F.when(none, _stub(first.dataType, bare, refs)).otherwise(parts[first.name])
    if "reference" in kind.fieldNames() and "_reference" in out.fieldNames():
        ref = value["reference"]
        good = _allowed(ref, refs, context)
        parts["reference"] = F.when(good, ref)
        parts["_reference"] = F.when(ref.isNotNull() & ~good, F.struct(F.array(_mark()).alias("extension")))
    if marks is not None:
        parts["extension"] = marks
    return _built(out, parts)


def _values(value: Column, kind: T.DataType, context: Context, refs: Column, name: str) -> Column:
    """A struct, or a list of them, redacted value by value; slices that are missing beside matched ones are marked.

    Beside each value stands which slices it matches (`hit`), and for each sliced context the last of them (`own`, -1 for none).
    """
    sliced = [] if UNSLICED in [at for _, at, _ in context] else [c for c in context if c[0].sliced(c[1])]
    listed = isinstance(kind, T.ArrayType)
    one_kind = kind.elementType if listed else kind
    if not isinstance(one_kind, T.StructType):
        return F.transform(value, lambda x: _values(x, one_kind, context, refs, name)) if listed and isinstance(one_kind, T.ArrayType) else value
    if not sliced:
        return F.transform(value, lambda x: _children(x, one_kind, context, refs)) if listed else _children(value, one_kind, context, refs)
    slices = [(p, p.by_id[at], s, i, j) for i, (p, at, _) in enumerate(sliced) for j, s in enumerate(p.slices(at))]
    spans = [[n for n, x in enumerate(slices) if x[3] == i] for i in range(len(sliced))]
    hits = lambda x: [matches_slice(p, base, s, x, one_kind, _type_name(name, base.element_id, base)) for p, base, s, _, _ in slices] or [F.lit(False)]

    def last(hit: Column, span: list[int]) -> Column:
        out = F.lit(-1)
        for n in span:
            out = F.when(hit[n], slices[n][4]).otherwise(out)
        return out

    tagged = F.transform(value if listed else F.array(value), lambda x: F.struct(x.alias("v"), F.array(*hits(x)).alias("hit")))
    tagged = F.transform(tagged, lambda x: F.struct(x["v"].alias("v"), x["hit"].alias("hit"), F.array(*(last(x["hit"], span) for span in spans)).alias("own")))
    out = F.transform(tagged, lambda x: _one(x, one_kind, context, refs, sliced))
    if not listed:
        return out[0]
    matched = lambda n: F.exists(tagged, lambda x: x["hit"][n])
    some = _any([matched(n) for n in range(len(slices))])
    for n, (_, _, s, i, _) in enumerate(slices):
        if s.min > 0:
            stub = _stub(one_kind, [(q, s.element_id, when) for q, _, when in context], refs)
            missing = _both(sliced[i][2], some & ~matched(n))
            out = F.when(missing, F.concat(out, F.array(stub))).otherwise(out)
    return out


def _one(tagged: Column, kind: T.StructType, context: Context, refs: Column, sliced: Context) -> Column:
    """One value: under the contexts of its slices, or emptied if it has none in any profile that slices it."""
    out_kind, needed = marked_type(kind), _needed(context)
    marks = F.when(needed, _marks(next(f.dataType for f in out_kind.fields if f.name == "extension"))) if needed is not None and "extension" in out_kind.fieldNames() else None
    emptied = _built(out_kind, {"extension": marks} if marks is not None else {})
    mine = [(p, s.element_id, _both(when, tagged["own"][i] == j)) for i, (p, at, when) in enumerate(sliced) for j, s in enumerate(p.slices(at))]
    unsliced = [c for c in context if not c[0].sliced(c[1])]
    none = _holding([when for _, _, when in sliced]) & ~_any([w for _, _, w in mine])
    return F.when(none, emptied).otherwise(_children(tagged["v"], kind, [*mine, *unsliced], refs))


def _extensions(value: Column, kind: T.DataType, context: Context, refs: Column, nested: bool = False) -> Column:
    """Extensions that some profile slices, or that say why data are absent; nested ones of a kept one survive where the
    profiles say nothing of them; those left without value and extension go.
    """
    own = _struct(kind)
    slices = [(p, s, when) for p, at, when in context for s in p.slices(at)]
    out_kind = marked_type(T.StructType([T.StructField("extension", kind)])).fields[0].dataType
    named = lambda e, p, s, when: F.coalesce(_both(when, e["url"].isin(_urls(p, s))), F.lit(False))
    kept = F.filter(value, lambda e: _any([F.coalesce(e["url"].isin(list(ABSENT_URLS)), F.lit(False)), *(named(e, *x) for x in slices)]))
    known = _holding([when for p, at, when in context if at in p.by_id]) if nested else F.lit(True)
    shown = value if known is None else F.when(known, kept).otherwise(value)

    def one(e: Column) -> Column:
        parts = {f.name: e[f.name] for f in own.fields}
        inner = next((f for f in own.fields if f.name == "extension"), None)
        if inner is not None:
            hit = [named(e, *x) for x in slices]
            under = [(q, f"{s.element_id}.extension", h) for (_, s, _), h in zip(slices, hit, strict=True) for q, _, _ in context]
            beside = [(p, f"{at}.extension", _both(when, ~_any(hit)) if hit else when) for p, at, when in context]
            parts["extension"] = _extensions(e["extension"], inner.dataType, [*under, *beside], refs, True)
        for f in own.fields:
            if f.name not in ("url", "extension") and _struct(f.dataType) is not None:
                parts[f.name] = _values(e[f.name], f.dataType, _descended(context, f.name), refs, f.name)
        return _built(out_kind.elementType, parts)

    full = lambda e: F.greatest(*(e[f.name].isNotNull() for f in own.fields if f.name not in ("url", "extension", "id")), F.coalesce(F.size(e["extension"]) > 0, F.lit(False)) if "extension" in own.fieldNames() else F.lit(False), F.lit(False))
    out = F.filter(F.transform(shown, one), full)
    return F.when(F.size(out) > 0, out)


def _urls(profile: Profile, own: Element) -> list[str]:
    """The urls of an extension slice: those of its profiles, or the fixed value of its url."""
    if own.type_profiles:
        return list(own.type_profiles)
    fixed = profile.by_id.get(f"{own.element_id}.url")
    return [json.loads(fixed.pattern)] if fixed is not None and fixed.pattern is not None else []


def redacted(value: Column, kind: T.StructType, profiles: Sequence[Profile], resource_type: str, refs: Column) -> Column:
    """A record (of marked_type(kind)) as the profiles allow it; refs maps attribute ids to the references they may show, ascending."""
    return _children(value, kind, [(p, resource_type, None) for p in profiles], refs)


# --- whole records ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """What a group takes of its records: element ids and the profile they belong to."""

    group_id: str
    profile: Profile
    element_ids: tuple[str, ...]


def copy_and_redact(records: DataFrame, resource_type: str, kind: T.StructType, selections: Sequence[Selection]) -> DataFrame:
    """body (JSON) and `complete` of each record of one type.

    records: body (a struct of type kind), groups (sorted array of the valid groups of the record, from `selections`), refs (map from
    attribute id to its allowed references), conforms where slices depend on it (map from references, ascending, to the profiles of their
    targets, see resolve.conformance) and other columns, which are kept. References are looked up by halving, so a record of very many
    costs little more than their number. One expression is compiled for each set of groups that occurs. complete is false where a record does not claim all profiles of its groups (patients always do):
    such records are to be rejected. meta.profile keeps the claimed profiles of the groups only.
    """
    known = {s.group_id: s for s in selections}
    sets = [tuple(r["groups"]) for r in records.select("groups").distinct().collect()]  # sets of groups, not of records
    body, complete = F.lit(None).cast("string"), F.lit(False)
    conforms = F.col("conforms") if "conforms" in records.columns else None
    none = F.create_map().cast("map<string,array<string>>")
    records = records.withColumn("refs", F.transform_values(F.coalesce("refs", none), lambda _, v: F.array_sort(F.array_compact(v))))
    refs = F.col("refs")
    has_profiles = "meta" in kind.fieldNames() and "profile" in kind["meta"].dataType.fieldNames()
    for groups in sets:
        own = [known[g] for g in groups if g in known]
        if not own:
            continue
        profiles = list({s.profile.url: s.profile for s in own}.values())
        urls = [p.url for p in profiles]
        tree = _united([copy_tree(s.element_ids) for s in own])
        cut = copied(F.col("body"), kind, [(None, resource_type, tree)], profiles, conforms)
        done = redacted(cut, kind, profiles, resource_type, refs)
        claimed = F.lit(True)
        if has_profiles:
            mine = F.transform(F.coalesce(F.col("body")["meta"]["profile"], F.array().cast("array<string>")), lambda p: F.substring_index(p, "|", 1))
            shown = F.array(*map(F.lit, urls)) if resource_type == "Patient" else F.array_intersect(F.array(*map(F.lit, urls)), mine)
            meta = done["meta"].withField("profile", shown)
            done = done.withField("meta", F.coalesce(meta, F.from_json(F.lit("{}"), marked_type(kind)["meta"].dataType).withField("profile", shown)))
            if resource_type != "Patient":
                claimed = F.size(F.array_except(F.array(*map(F.lit, urls)), mine)) == 0
        this = F.col("groups") == F.array(*map(F.lit, groups))
        body = F.when(this, F.to_json(done)).otherwise(body)
        complete = F.when(this, claimed).otherwise(complete)
    return records.withColumns({"body": body, "complete": complete}).drop("refs", "conforms")
