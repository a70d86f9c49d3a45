"""Value sets and numbers of values: what a profile binds an element to, and how many values it lets it have.

A catalogue of value sets is a table of rules: value_set, part (include or exclude), how, system, code, imported. `how` is
`code` (that code), `is-a` (the code and all below it in its system's tree), `system` (all codes of the system) or `import` (what the
value set `imported` has, of `system` only where that is given). Excluded rules take from what their own set includes; excluded
imports are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators import codes, redact
from cohortlake.plans.lineage import cut

#: Depth is the longest chain of imports.
MAX_ROUNDS = 100
#: Pieces that a frequent coding's rows are dealt to where verdicts are too many to be sent to every task, and how many are sent.
SALTS, MOST_SENT = 32, 1 << 18

_KEY = ["value_set", "system", "code"]


def _listed(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """part, value_set, system, code of the rules that name codes or systems; code is null for a whole system."""
    named = rules.where("how IN ('code', 'system')").select("part", "value_set", "system", F.when(F.col("how") == "code", F.col("code")).alias("code"))
    above = rules.where("how = 'is-a'").select("part", "value_set", "system", F.col("code").alias("root"))
    return named.unionByName(above.join(codes.expand(above.select("system", F.col("root").alias("code")), edges), ["system", "root"]).select("part", *_KEY)).distinct()


def members(rules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What value sets hold and what of it they leave out, both as value_set, system, code (null: all codes of the system).

    Both matter where a whole system is included and some of its codes are not. Sets that import each other hold the same.
    Edges are those of code trees (system, parent, child).
    """
    listed = cut(_listed(rules, edges), "value-set-rules")
    left_out = listed.where("part = 'exclude'").select(*_KEY)
    imports = rules.where("part = 'include' AND how = 'import'").select(F.col("value_set").alias("__to"), F.col("imported").alias("value_set"), F.col("system").alias("__only")).distinct()

    def without(rows: DataFrame) -> DataFrame:
        whole = left_out.where("code IS NULL").select("value_set", "system")
        return rows.join(left_out.where("code IS NOT NULL"), _KEY, "left_anti").join(whole, ["value_set", "system"], "left_anti")

    known = frontier = cut(without(listed.where("part = 'include'").select(*_KEY)), "value-sets")
    bars = left_out.where("code IS NOT NULL")
    for _ in range(MAX_ROUNDS):
        found = frontier.join(imports, "value_set").where("__only IS NULL OR __only = system").select(F.col("__to").alias("value_set"), "system", "code")
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in _KEY]
        frontier = cut(without(found.distinct()).alias("f").join(known.alias("k"), same, "left_anti"), "value-sets")
        # codes that a set leaves out of a whole system are left out by those that import the system from it
        more = bars.join(imports, "value_set").where("__only IS NULL OR __only = system").select(F.col("__to").alias("value_set"), "system", "code").join(bars, _KEY, "left_anti").distinct()
        more = cut(more, "value-set-bars")
        if frontier.isEmpty() and more.isEmpty():
            return known, bars
        known, bars = known.union(frontier), bars.union(more)
    raise RuntimeError(f"value sets import each other over more than {MAX_ROUNDS} steps")


def allowed(asked: DataFrame, held: DataFrame, left_out: DataFrame) -> DataFrame:
    """Those of asked (value_set, system, code; distinct) that value sets (as from members) hold.

    A code that is held by name is held whatever is left out; left-out codes count against whole systems.
    """
    named = asked.join(held.where("code IS NOT NULL"), _KEY, "left_semi")
    whole = asked.join(held.where("code IS NULL").select("value_set", "system"), ["value_set", "system"], "left_semi").join(left_out, _KEY, "left_anti")
    return named.union(whole).distinct()


def within(codings: DataFrame, held: DataFrame, left_out: DataFrame) -> DataFrame:
    """The rows of codings (value_set, system, code and other columns) whose coding is in its value set; repeated rows stay repeated.

    Each distinct coding is judged once, and before anything else moves. Verdicts go to every task where they are few; else rows
    are dealt to SALTS pieces, so a coding that a third of all records have is spread. Codings without system or code are in no set.
    """
    asked = codings.select(*_KEY).where("system IS NOT NULL AND code IS NOT NULL").distinct()
    good = cut(allowed(asked, held, left_out), "codings-allowed")
    if good.count() <= MOST_SENT:
        return codings.join(F.broadcast(good), _KEY, "left_semi")
    told = [c for c, kind in codings.dtypes if "map<" not in kind]  # a hash, not chance: tasks that run again deal alike
    salted = codings.withColumn("__salt", F.pmod(F.xxhash64(*told), F.lit(SALTS)).cast("int"))
    return salted.join(good.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*_KEY, "__salt"], "left_semi").select(*codings.columns)


def bound_codings(records: DataFrame, keys: Sequence[str], column: str, value_set: Column, held: DataFrame, left_out: DataFrame) -> DataFrame:
    """records, where the list of codings in `column` (structs with system and code) keeps only those that value_set holds.

    Only keys and codings move until the lists are joined to their records; order stays. keys tell records apart (rows that share them
    are not told apart; null keys never match and lose all codings). A null list stays null, and so does everything where value_set is null (not bound).
    """
    each = records.where(value_set.isNotNull()).select(*keys, value_set.alias("value_set"), F.posexplode(column).alias("__at", "__c"))
    rows = within(each.select(*keys, "value_set", F.col("__c.system").alias("system"), F.col("__c.code").alias("code"), "__at", "__c"), held, left_out)
    lists = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct("__at", "__c"))), lambda x: x["__c"]).alias("__kept"))
    kept = F.coalesce("__kept", F.filter(F.col(column), lambda _: F.lit(False)))
    return records.join(lists, [*keys], "left").withColumn(column, F.when(value_set.isNull() | F.col(column).isNull(), F.col(column)).otherwise(kept)).select(*records.columns)


# --- numbers of values -----------------------------------------------------------------------------------------------


def _most(value: Column, kind: T.DataType, steps: Sequence[str], counts) -> Column:
    """The greatest number of values at `steps` below any one parent; counts says how many of a value or list count."""
    if isinstance(kind, T.ArrayType) and steps:
        return F.coalesce(F.array_max(F.transform(value, lambda x: _most(x, kind.elementType, steps, counts))), F.lit(0))
    if not steps:
        return F.coalesce(counts(value, kind), F.lit(0))
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    stem = steps[0][:-3] if steps[0].endswith("[x]") else None
    named = [n for n in fields if n == steps[0] or stem and n.startswith(stem) and n[len(stem) : len(stem) + 1].isupper()]
    parts = [_most(value[n], fields[n], steps[1:], counts) for n in named]
    if stem and len(steps) == 1:  # a choice has a value in one of its fields
        return sum(parts, F.lit(0))
    return F.greatest(F.lit(0), F.lit(0), *parts)


def over_max(record: Column, kind: T.StructType, profile: redact.Profile) -> Column:
    """Ids of the profile's elements, in its order, that have more values than their `max` below one parent; slices count their own values.

    Elements inside slices count at their path, whatever slice their parent is in, and so are left to their unsliced twins.
    """
    tests = []
    for e in profile.elements:
        if e.max is None or not e.max.isdigit() or "." not in e.path or ":" in e.element_id.rsplit(".", 1)[0]:
            continue

        def counts(value: Column, of: T.DataType, e: redact.Element = e) -> Column:
            if ":" not in e.element_id:
                return F.when(value.isNotNull(), F.size(value) if isinstance(of, T.ArrayType) else F.lit(1))
            base = profile.by_id[e.element_id.rsplit(":", 1)[0]]
            listed = value if isinstance(of, T.ArrayType) else F.array_compact(F.array(value))
            one = of.elementType if isinstance(of, T.ArrayType) else of
            return F.size(F.filter(listed, lambda x: redact.matches_slice(profile, base, e, x, one)))

        if ":" in e.element_id and not profile.sliced(e.element_id.rsplit(":", 1)[0]):
            continue
        tests.append(F.when(_most(record, kind, e.path.split(".")[1:], counts) > int(e.max), F.lit(e.element_id)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
