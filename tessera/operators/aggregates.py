"""Grouped metrics, dense calendars, period comparison, ranking and drill-through."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.predicates import RequestError, bounded, half_open

STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def bucket_start(column: str, interval: str) -> Column:
    """Start of the day, week (from Monday) or month on the column's wall clock."""
    return F.date_trunc(interval, F.col(column))


def next_bucket(column: str, interval: str) -> Column:
    return F.col(column) + F.expr(STEPS[interval])


def valid_hours(is_closed: Column, hours: Column) -> Column:
    """hours of closed rows with a finite, non-negative duration, else null."""
    return F.when(is_closed & hours.isNotNull() & ~F.isnan(hours) & (hours >= 0) & (hours < float("inf")), hours)


def metrics(is_closed: Column, hours: Column) -> dict[str, Column]:
    """count, closed_count, open_count (all not closed, unknown included), mean_hours, median_hours, p90_hours.

    Percentiles are exact with linear interpolation. Counts of nothing are 0, durations of nothing are null.
    """
    closed = F.coalesce(F.sum(F.when(is_closed, 1).otherwise(0)), F.lit(0)).cast("long")
    good = valid_hours(is_closed, hours)
    return {
        "n": F.count(F.lit(1)),
        "closed_count": closed,
        "open_count": F.count(F.lit(1)) - closed,
        "mean_hours": F.avg(good),
        "median_hours": F.percentile(good, F.lit(0.5)),
        "p90_hours": F.percentile(good, F.lit(0.9)),
    }


def grouped(df: DataFrame, keys: list[str], measures: Mapping[str, Column], max_groups: int | None = None, min_count: int = 0) -> DataFrame:
    """measures for each group, nulls being a group of their own; without keys one row, even of nothing. More than
    max_groups groups are an error. min_count drops small groups by the measure `n`."""
    out = df.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])
    if max_groups is not None and keys:
        out = bounded(out, max_groups, "groups")
    return out.where(F.col("n") >= min_count) if min_count else out


def ranked(df: DataFrame, by: str, keys: list[str], descending: bool = True, top: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in the order of a metric, nulls last, ties by key; `top` of them from `offset` on."""
    order = [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), *[F.asc_nulls_first(k) for k in keys]]
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(top) if top is not None else out


def dense_calendar(observed: DataFrame, bucket: str, keys: list[str], start: str, end: str, interval: str, counts: list[str]) -> DataFrame:
    """One row for each observed key combination and each bucket from start until before end; counts of missing rows
    are 0, other measures null."""
    own = [f"wanted_{k}" for k in keys]
    combinations = observed.select(*[F.col(k).alias(w) for k, w in zip(keys, own, strict=True)]).distinct()
    buckets = F.expr(f"sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}' - INTERVAL 1 SECOND, {STEPS[interval]})")
    wanted = combinations.withColumn("spine", F.explode(buckets))
    same = reduce(Column.__and__, [F.col(w).eqNullSafe(F.col(k)) for k, w in zip(keys, own, strict=True)], F.col("spine") == F.col(bucket))
    rest = [c for c in observed.columns if c not in (bucket, *keys)]
    filled = [F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in rest]
    return wanted.join(observed, same, "left").select(*[F.col(w).alias(k) for k, w in zip(keys, own, strict=True)], F.col("spine").alias(bucket), *filled)


def compare_periods(df: DataFrame, keys: list[str], column: str, baseline: tuple[str, str], current: tuple[str, str], days: tuple[int, int], min_count: int = 0) -> DataFrame:
    """Counts of both half-open periods for each group, daily rates, absolute and relative change and rate change, in
    one pass. Relative changes are null where the baseline has none; min_count applies to both counts together."""
    a, b = half_open(column, *baseline), half_open(column, *current)
    out = df.where(a | b).groupBy(*keys).agg(F.count(F.when(a, 1)).alias("baseline_n"), F.count(F.when(b, 1)).alias("current_n"))
    out = out.where(F.col("baseline_n") + F.col("current_n") >= min_count)
    rates = out.withColumns({"baseline_rate": F.col("baseline_n") / days[0], "current_rate": F.col("current_n") / days[1]})
    some = F.nullif(F.col("baseline_n"), F.lit(0))
    return rates.withColumns({"absolute_change": F.col("current_n") - F.col("baseline_n"), "relative_change": (F.col("current_n") - F.col("baseline_n")) / some, "rate_change": (F.col("current_rate") - F.col("baseline_rate")) / F.nullif(F.col("baseline_rate"), F.lit(0.0))})


def drill_through(facts: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of facts in any of the chosen groups; a null key matches null."""
    return facts.join(chosen, reduce(Column.__and__, [facts[k].eqNullSafe(chosen[k]) for k in keys]), "left_semi")


def reconciled(groups: DataFrame, total: int, count: str = "n") -> DataFrame:
    """groups, or an error if their counts don't add up to the exact total."""
    if (found := groups.agg(F.sum(count)).first()[0] or 0) != total:
        raise ValueError(f"groups hold {found} rows of {total}")
    return groups


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order must be total for a stable result."""
    return df.withColumn("row_of_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("row_of_key = 1").drop("row_of_key")


def best_and_margin(df: DataFrame, keys: list[str], score: str, choice: str) -> DataFrame:
    """For each key the best choice, its score, the gap to the runner-up and to the best score of another choice (null
    if there is none). Ties go to the smaller choice."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(choice))
    all_rows = Window.partitionBy(*keys)
    rows = df.withColumn("best_choice", F.first(choice).over(order)).withColumn("next_score", F.lead(score).over(order)).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("other_score", F.max(F.when(F.col(choice) != F.col("best_choice"), F.col(score))).over(all_rows))
    return rows.where("place = 1").select(*keys, F.col("best_choice"), F.col(score).alias("best_score"), (F.col(score) - F.col("next_score")).alias("margin"), (F.col(score) - F.col("other_score")).alias("distinct_margin"))


def running_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """Rows of each key in order until their summed size would exceed `most`; the first that does ends it."""
    used = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).where(F.col("used") <= most)


def listed(df: DataFrame, keys: list[str], order: list[str], columns: list[str], most: int) -> DataFrame:
    """keys, items: the rows of each key as an array of structs in order; a key of more than `most` rows is an error, as
    what follows folds the array in one task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if counts > most:
        raise RequestError("budget_exceeded", f"{counts} rows of one key; at most {most} are folded")
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("items"))


def greedy_budget(df: DataFrame, keys: list[str], order: list[str], size: str, most: int, columns: list[str], longest: int = 10_000) -> DataFrame:
    """keys, order, columns, size, used: the rows of each key in order that still fit into what those before have left of
    `most`. A row that doesn't fit is passed over, and later smaller ones may still fit. order: columns, null ones first;
    it must be total for a stable result. A null size counts as 0."""
    rows = listed(df, keys, order, [*columns, size], longest)
    start = F.struct(F.lit(0).cast("double").alias("used"), F.array().cast("array<double>").alias("after"))

    def step(held: Column, x: Column) -> Column:
        total = held["used"] + F.coalesce(x[size].cast("double"), F.lit(0.0))
        fits = total <= most
        return F.struct(F.when(fits, total).otherwise(held["used"]).alias("used"), F.concat(held["after"], F.array(F.when(fits, total))).alias("after"))

    folded = rows.withColumn("after", F.aggregate("items", start, step)["after"])
    each = folded.select(*keys, F.explode(F.arrays_zip("items", "after")).alias("x")).where("x.after is not null")
    return each.select(*keys, "x.items.*", F.col("x.after").alias("used"))


def median_of(values: Column) -> Column:
    """The median of a non-empty array of numbers."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def tolerance_groups(df: DataFrame, keys: list[str], position: str, extent: str, tie: str, least: float = 2.0, share: float = 0.4, longest: int = 10_000) -> DataFrame:
    """keys, position, tie, extent, line (from 1): rows of each key in order of position, in one line as long as they lie
    near the line so far: at most `share` of the smaller of the row's and the line's median extent, and `least` at least,
    from the line's median position. The line moves with the rows that it takes. Rows without a position or extent are left
    out."""
    rows = listed(df.where(F.col(position).isNotNull() & F.col(extent).isNotNull()), keys, [position, tie], [extent], longest)
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0).alias("line"), none.alias("at"), none.alias("extents"), F.array().cast("array<int>").alias("lines"))

    def step(held: Column, x: Column) -> Column:
        at, wide = x[position].cast("double"), x[extent].cast("double")
        near = F.abs(at - median_of(held["at"])) <= F.greatest(F.lit(least), F.least(wide, median_of(held["extents"])) * share)
        joins = F.coalesce((held["line"] > 0) & near, F.lit(False))
        line = F.when(joins, held["line"]).otherwise(held["line"] + 1)
        return F.struct(line.alias("line"), F.when(joins, F.concat(held["at"], F.array(at))).otherwise(F.array(at)).alias("at"), F.when(joins, F.concat(held["extents"], F.array(wide))).otherwise(F.array(wide)).alias("extents"), F.concat(held["lines"], F.array(line)).alias("lines"))

    folded = rows.withColumn("lines", F.aggregate("items", start, step)["lines"])
    each = folded.select(*keys, F.explode(F.arrays_zip("items", "lines")).alias("x"))
    return each.select(*keys, "x.items.*", F.col("x.lines").alias("line"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a share; null of nothing."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = successes / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return (centre - half) / (1 + z2 / n), (centre + half) / (1 + z2 / n)


def calibration_bins(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_probability, observed, low, high (Wilson 95 %), gap of each filled bin."""
    place = F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)).cast("int").alias("bin")
    out = df.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.sum(F.col(label).cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    observed = F.col("hits") / F.col("n")
    return out.select("bin", "n", "mean_probability", observed.alias("observed"), low.alias("low"), high.alias("high"), F.abs(F.col("mean_probability") - observed).alias("gap"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def calibrator(df: DataFrame, score: str, label: str, penalty: float = 1.0) -> tuple[float, float]:
    """Coefficient and intercept of a logistic fit of label (0, 1) on score with an L2 penalty on the coefficient of
    1 / (2 penalty) beside the summed loss: Newton steps, each one aggregation over the rows."""
    slope = intercept = 0.0
    x, y = F.col(score), F.col(label).cast("double")
    for _ in range(50):
        p = sigmoid(F.lit(slope) * x + F.lit(intercept))
        w = p * (1 - p)
        s = df.agg(F.sum((p - y) * x).alias("gx"), F.sum(p - y).alias("g1"), F.sum(w * x * x).alias("hxx"), F.sum(w * x).alias("hx"), F.sum(w).alias("h1")).first()
        gx, hxx = s["gx"] + slope / penalty, s["hxx"] + 1 / penalty
        det = hxx * s["h1"] - s["hx"] ** 2
        step = ((gx * s["h1"] - s["g1"] * s["hx"]) / det, (s["g1"] * hxx - gx * s["hx"]) / det)
        slope, intercept = slope - step[0], intercept - step[1]
        if max(map(abs, step)) < 1e-10:
            break
    return slope, intercept


def calibration_scores(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """One row: n, positives, brier, log_loss (probabilities held 1e-15 off 0 and 1), calibration_error (the bins' gaps
    weighted by their rows)."""
    p, y = F.col(probability), F.col(label).cast("double")
    safe = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    each = df.groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(p).alias("p_sum"), F.sum(y).alias("y_sum"), F.sum((p - y) * (p - y)).alias("squares"), F.sum(y * F.log(safe) + (1 - y) * F.log(1 - safe)).alias("logs")
    )
    n = F.sum("rows")
    return each.agg(n.alias("n"), F.sum("y_sum").cast("long").alias("positives"), (F.sum("squares") / n).alias("brier"), (-F.sum("logs") / n).alias("log_loss"), (F.sum(F.abs(F.col("p_sum") - F.col("y_sum"))) / n).alias("calibration_error"))


def retrieval_metrics(ranked: DataFrame, keys: list[str], place: str, relevant: Column, k: int = 10) -> DataFrame:
    """keys, recall (relevant rows among the first k of all relevant ones; null without any) and reciprocal_rank (of the
    first relevant row among the first k, else 0)."""
    hit = F.when((F.col(place) <= k) & relevant, F.col(place))
    sums = ranked.groupBy(*keys).agg(F.count(hit).alias("hits"), F.count(F.when(relevant, 1)).alias("good"), F.min(hit).alias("first_hit"))
    return sums.select(*keys, (F.col("hits") / F.nullif(F.col("good"), F.lit(0))).alias("recall"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"))


def facets(df: DataFrame, keys: list[str], options: list[str]) -> DataFrame:
    """keys, n and, for each option column, its sorted distinct values joined by |."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.array_join(F.array_sort(F.collect_set(F.col(o).cast("string"))), "|").alias(o) for o in options])


def located(df: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """keys, n, located, unlocated: rows with and without a place."""
    here = F.count(F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in place]), 1))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), here.alias("located"), (F.count(F.lit(1)) - here).alias("unlocated"))
