"""Code trees and cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.temporal import compare
from cohortlake.plans.lineage import cut

MAX_DEPTH = 100


def expand(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """(system, root, code): each wanted code (system, code) and all below it in its system; cycles end, unknown codes stand alone."""
    tree = edges.select("system", F.col("parent").alias("code"), "child")
    known = frontier = cut(wanted.select("system", F.col("code").alias("root"), "code").distinct(), "codes")
    for _ in range(MAX_DEPTH):
        found = frontier.join(tree, ["system", "code"]).select("system", "root", F.col("child").alias("code")).distinct()
        frontier = cut(found.join(known, ["system", "root", "code"], "left_anti"), "codes")
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
    raise RuntimeError(f"code tree deeper than {MAX_DEPTH}")


@dataclass(frozen=True)
class Criterion:
    """Records with one of the codes, and if given with a value that compares so, or with one of the concepts as value."""

    codes: Sequence[tuple[str, str]] = ()
    comparator: str | None = None
    value: float | None = None
    concepts: Sequence[tuple[str, str]] = ()

    def __post_init__(self) -> None:
        for name in ("codes", "concepts"):
            object.__setattr__(self, name, tuple(map(tuple, getattr(self, name))))


def with_descendants(codes: Sequence[tuple[str, str]], edges: DataFrame) -> list[tuple[str, str]]:
    """The codes and all below them in their systems' trees; what is wanted is part of a request, and so is what comes back."""
    if not codes:
        return []
    rows = expand(edges.sparkSession.createDataFrame([*codes], "system string, code string"), edges).select("system", "code").distinct()
    return sorted((r["system"], r["code"]) for r in rows.collect())


def _isin(system: Column, code: Column, wanted: Sequence[tuple[str, str]]) -> Column:
    return F.struct(system.alias("system"), code.alias("code")).isin([F.struct(F.lit(s).alias("system"), F.lit(k).alias("code")) for s, k in wanted])


def _meets(c: Criterion, edges: DataFrame | None) -> Column:
    """Whether a record meets a criterion."""
    out = _isin(F.col("system"), F.col("code"), with_descendants(c.codes, edges) if edges is not None else list(c.codes))
    if c.comparator:
        out &= compare(c.comparator, F.col("value"), F.lit(c.value))
    if c.concepts:
        out &= _isin(F.col("value_system"), F.col("value_code"), c.concepts)
    return F.coalesce(out, F.lit(False))


#: Criteria that share one mask: the bits of a long but for its sign.
_BITS = 63


def select_cohort(people: DataFrame, records: DataFrame, include: Sequence[Sequence[Criterion]], exclude: Sequence[Sequence[Criterion]] = (), edges: DataFrame | None = None) -> DataFrame:
    """patient_id of those who meet one criterion of every inner list of include, and not so of exclude.

    records has patient_id, system, code, value, and for concept filters value_system and value_code. With edges (system,
    parent, child) a criterion's codes stand for all below them, too.

    Records are read once: each sets the bits of the criteria that it meets, a person's bits are joined by OR before they move,
    and the lists are asked of these bits. An empty inner list is met by nobody; without include all people are taken.
    """
    criteria = list(dict.fromkeys(c for lists in (include, exclude) for any_of in lists for c in any_of))
    tests = [_meets(c, edges) for c in criteria]
    bit = {c: (n // _BITS, 1 << n % _BITS) for n, c in enumerate(criteria)}
    words = range(-(-len(criteria) // _BITS))
    zero = F.lit(0).cast("long")
    masks = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(t, F.lit(bit[c][1]).cast("long")).otherwise(zero) for c, t in zip(criteria, tests, strict=True) if bit[c][0] == w], zero).alias(f"m{w}") for w in words]

    def meet(lists: Sequence[Sequence[Criterion]]) -> Column:
        out = F.lit(True)
        for any_of in lists:
            one = F.lit(False)
            for w in words:
                wanted = sum(bit[c][1] for c in set(any_of) if bit[c][0] == w)
                one |= F.col(f"m{w}").bitwiseAND(F.lit(wanted).cast("long")) != 0
            out &= one
        return out

    everyone = people.select("patient_id").distinct()
    if not criteria:
        return everyone.where(F.lit(not any(len(x) == 0 for x in include)) & F.lit(not exclude or any(len(x) == 0 for x in exclude)))
    of = records.where(reduce(lambda a, b: a | b, tests)).select("patient_id", *masks).groupBy("patient_id").agg(*(F.bit_or(f"m{w}").alias(f"m{w}") for w in words))
    held = everyone.join(of, "patient_id", "left").na.fill(0, [f"m{w}" for w in words])
    return held.where(meet(include) & (~meet(exclude) if exclude else F.lit(True))).select("patient_id")
