"""Normalisation with quality flags, strict local times, duplicates and profiles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = "missing_"


def strict_utc(local: Column, zone: str, offsets: tuple[int, ...]) -> tuple[Column, Column]:
    """The UTC wall clock of a local one and how many there are: a time that the clocks skip has none, one that they
    repeat has two; both give null. offsets: the zone's possible hours behind UTC."""
    naive = local.cast("timestamp_ntz")
    tries = [naive + F.expr(f"INTERVAL {h} HOURS") for h in offsets]
    good = [F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), t) == naive, t) for t in tries]
    found = F.array_distinct(F.array_compact(F.array(*good)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))), F.size(found)


def duration_hours(start: Column, end: Column) -> Column:
    def micros(t: Column) -> Column:
        return F.unix_micros(t.cast("timestamp"))

    return (micros(end) - micros(start)) / 3.6e9


def flags(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, sorted; a test that is null doesn't."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests.items()])))


def normalized_requests(raw: DataFrame, key: str, status: str, created: str, closed: str, texts: list[str], lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Trimmed texts (empty: null), is_closed (the status is exactly `closed`, in any case), closure_hours of closed
    rows with a sound duration, location, sorted quality_flags."""
    out = raw.withColumns({t: F.nullif(F.trim(t), F.lit("")) for t in texts})
    is_closed = F.coalesce(F.lower(F.trim(status)) == "closed", F.lit(False))
    hours = duration_hours(F.col(created), F.col(closed))
    tests = {
        "missing_created_date": F.col(created).isNull(),
        "closed_without_date": is_closed & F.col(closed).isNull(),
        "date_without_closed": ~is_closed & F.col(closed).isNotNull(),
        "negative_duration": hours < 0,
        **{REQUIRED + t: F.col(t).isNull() for t in texts},
    }
    columns = {"is_closed": is_closed, "closure_hours": F.when(is_closed & (hours >= 0), hours)}
    if lat and lon:
        y, x = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
        sound = F.coalesce(y.between(-90, 90) & x.between(-180, 180), F.lit(False))
        tests |= {"missing_location": y.isNull() | x.isNull(), "invalid_location": y.isNotNull() & x.isNotNull() & ~sound}
        columns["location"] = F.when(sound, F.struct(y.alias("lat"), x.alias("lon")))
    return out.withColumns(columns | {"quality_flags": flags(tests)})


def deduplicated(rows: DataFrame, keys: list[str], content: list[str], order: list[Column]) -> DataFrame:
    """rows with outcome: kept (the first of its key), duplicate (a later row of the same content) or quarantined (a
    later row of other content)."""
    mark = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("content_mark", mark).withColumn("first_mark", F.first("content_mark").over(window)).withColumn("place", F.row_number().over(window))
    outcome = F.when(F.col("place") == 1, "kept").when(F.col("content_mark") == F.col("first_mark"), "duplicate").otherwise("quarantined")
    return out.withColumn("outcome", outcome).drop("content_mark", "first_mark", "place")


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, present, missing, distinct_values, in one pass over the rows."""
    sums = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(f).alias(f"present_{i}") for i, f in enumerate(fields)], *[F.countDistinct(f).alias(f"distinct_{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"present_{i}").alias("present"), (F.col("total") - F.col(f"present_{i}")).alias("missing"), F.col(f"distinct_{i}").alias("distinct_values")) for i, f in enumerate(fields)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key names no parent; null keys name none and are left out."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("parent_id")).distinct(), F.col(key) == F.col("parent_id"), "left_anti")


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n_values, vals (sorted, joined by |) of the keys with more than one value."""
    found = F.array_sort(F.collect_set(F.col(value).cast("string")))
    return rows.groupBy(*keys).agg(F.size(found).cast("long").alias("n_values"), F.array_join(found, "|").alias("vals")).where("n_values > 1")


@dataclass(frozen=True)
class Rule:
    """What the rows of a table must be: `required` (not null or blank), `number`, `date` (can be read as one), `one_of`
    (values), `unique` (no other row has the id; the same row again is a duplicate, another one a conflict), or
    `reference` (to, a table and its column, has the value). A null meets all rules but required ones."""

    table: str
    kind: str
    column: str
    values: tuple[str, ...] = ()
    to: tuple[str, str] = ("", "")


def dataset_faults(tables: Mapping[str, DataFrame], keys: Mapping[str, str], rules: list[Rule]) -> DataFrame:
    """table, id, field, code of every fault: missing, not_a_number, not_a_date, unknown_value,
    duplicate_id, conflicting_id, unknown_<table>. keys: the id column of each table.

    The rules on values of a table are one pass; ids and each reference are one shuffle. Ids are shown as text.
    """
    parts = []
    for name, rows in tables.items():
        own = [r for r in rules if r.table == name]
        key = F.col(keys[name]).cast("string")
        codes = []
        for r in own:
            value = F.col(r.column)
            test = {
                "required": ("missing", value.isNull() | (F.trim(value.cast("string")) == "")),
                "number": ("not_a_number", value.isNotNull() & value.cast("string").try_cast("double").isNull()),
                "date": ("not_a_date", value.isNotNull() & value.cast("string").try_cast("date").isNull()),
                "one_of": ("unknown_value", ~F.coalesce(value.cast("string").isin(*r.values), F.lit(True))),
            }.get(r.kind)
            if test:
                codes.append(F.when(test[1], F.struct(F.lit(r.column).alias("field"), F.lit(test[0]).alias("code"))))
        if codes:
            parts.append(rows.select(key.alias("id"), F.explode(F.array_compact(F.array(*codes))).alias("x")).select(F.lit(name).alias("table"), "id", "x.field", "x.code"))
        for r in own:
            if r.kind == "unique":
                alike = rows.where(F.col(r.column).isNotNull()).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows_alike"))
                ids = alike.groupBy(F.col(r.column).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("rows_alike").alias("n")).where("n > 1")
                code = F.when(F.col("kinds") > 1, "conflicting_id").otherwise("duplicate_id")
                parts.append(ids.select(F.lit(name).alias("table"), "id", F.lit(r.column).alias("field"), code.alias("code")))
            elif r.kind == "reference":
                there = tables[r.to[0]].select(F.col(r.to[1]).alias("referred")).distinct()
                lost = rows.where(F.col(r.column).isNotNull()).join(there, F.col(r.column) == F.col("referred"), "left_anti")
                parts.append(lost.select(F.lit(name).alias("table"), key.alias("id"), F.lit(r.column).alias("field"), F.lit(f"unknown_{r.to[0]}").alias("code")))
    return reduce(DataFrame.unionByName, parts)
