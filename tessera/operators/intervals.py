"""Specification facts as intervals: numeric predicates, units and three-valued clauses with conflicts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def same_number(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))


def bounds(value: Column, value_max: Column, minus: Column, plus: Column, approximate: Column) -> tuple[Column, Column]:
    """low and high of a fact: value (to value_max) widened by its tolerance; both null if the fact is approximate."""
    sound = ~F.coalesce(approximate, F.lit(False))
    return F.when(sound, value - F.coalesce(minus, F.lit(0.0))), F.when(sound, F.coalesce(value_max, value) + F.coalesce(plus, F.lit(0.0)))


def satisfies(low: Column, high: Column, op: str, a: float, b: float | None = None) -> Column:
    """Whether the whole interval meets the predicate: eq, lt, lte, gt, gte, between or contains (the interval holds
    a); null if the interval is undefined."""
    x = F.lit(float(a))
    if op == "between":
        y = F.lit(float(b))
        return ((low >= x) | same_number(low, x)) & ((high <= y) | same_number(high, y))
    tests = {
        "eq": same_number(low, x) & same_number(high, x),
        "lt": (high < x) & ~same_number(high, x),
        "lte": (high <= x) | same_number(high, x),
        "gt": (low > x) & ~same_number(low, x),
        "gte": (low >= x) | same_number(low, x),
        "contains": ((low <= x) | same_number(low, x)) & ((high >= x) | same_number(high, x)),
    }
    return tests[op]


def conditions_apply(conditions: Column, selected: list[str]) -> Column:
    """Whether a fact's conditions are among the selected ones."""
    return F.size(F.array_except(F.coalesce(conditions, F.array().cast("array<string>")), F.lit(selected).cast("array<string>") if selected else F.array().cast("array<string>"))) == 0


def clause_status(facts: DataFrame, scope: list[str], constraint: str, outcome: str) -> DataFrame:
    """scope, status of a conjunction: false over conflict over unknown over true.

    facts: one row for each fact that a constraint applies to, outcome boolean or null (undefined); a constraint
    without a fact has one row with a null outcome. Facts that disagree make the constraint a conflict.
    """
    each = facts.groupBy(*scope, constraint).agg(F.bool_or(outcome).alias("any_true"), F.bool_and(outcome).alias("all_true"), F.count(outcome).alias("known"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("known") == 0, "unknown").when(F.col("all_true") & (F.col("known") == F.col("n")), "true").when(~F.col("any_true") & (F.col("known") == F.col("n")), "false").when(F.col("any_true") & ~F.col("all_true"), "conflict").otherwise("unknown")
    each = each.withColumn("state", state)
    return each.groupBy(*scope).agg(precedence("false", "conflict", "unknown", "true").alias("status"))


def precedence(*order: str) -> Column:
    """The first of the states that occurs in the group (column state)."""
    return F.coalesce(*[F.when(F.bool_or(F.col("state") == s), F.lit(s)) for s in order])


def any_clause(statuses: DataFrame, scope: list[str]) -> DataFrame:
    """scope, status over alternative clauses: true wins, then conflict, unknown, false."""
    return statuses.withColumnRenamed("status", "state").groupBy(*scope).agg(precedence("true", "conflict", "unknown", "false").alias("status"))


def convert(df: DataFrame, value: str, unit: str, units: Mapping[str, tuple[str, float]], to: str) -> DataFrame:
    """df with converted and unit_problem: value in the unit `to`; null and a reason if the unit is unknown or of
    another quantity. units: unit -> (quantity, factor to the quantity's base)."""
    quantity, factor = units[to]
    known = F.create_map(*[x for u, (q, f) in units.items() for x in (F.lit(u), F.struct(F.lit(q).alias("quantity"), F.lit(f).alias("factor")))])
    out = df.withColumn("unit_entry", F.try_element_at(known, F.col(unit)))
    problem = F.when(F.col("unit_entry").isNull(), "unknown_unit").when(F.col("unit_entry.quantity") != quantity, "incompatible_unit")
    return out.withColumn("unit_problem", problem).withColumn("converted", F.when(F.col("unit_problem").isNull(), F.col(value) * F.col("unit_entry.factor") / factor)).drop("unit_entry")


def revision_disagreement(facts: DataFrame, document: str, same: list[str], low: str, high: str) -> DataFrame:
    """Facts for which another document states another interval of the same thing; no pairs are made: an interval
    differs if the extremes over the documents' intervals do."""
    spread = facts.groupBy(*same).agg(F.min(low).alias("l0"), F.max(low).alias("l1"), F.min(high).alias("h0"), F.max(high).alias("h1"), F.countDistinct(document).alias("docs"))
    apart = spread.where((F.col("docs") > 1) & ~(same_number(F.col("l0"), F.col("l1")) & same_number(F.col("h0"), F.col("h1"))))
    return facts.join(apart.select(*[F.col(k).alias(f"s_{k}") for k in same]), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in same]), "left_semi")
