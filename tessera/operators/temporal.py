"""Bitemporal projections: what was known at a cut, what holds at an instant, disputes and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import cycles


def known_at(events: DataFrame, seq: str, published: str, last_seq: int, cutoff: object) -> DataFrame:
    return events.where((F.col(seq) <= last_seq) & (F.col(published) <= F.lit(cutoff)))


def valid_at(start: Column, end: Column, at: object, start_known: Column | None = None, end_known: Column | None = None) -> Column:
    """start <= at < end; a null end is open. Rows whose start isn't known, or whose end is unknown, don't hold."""
    holds = (start <= F.lit(at)) & (end.isNull() | (F.lit(at) < end))
    for gate in (start_known, end_known):
        holds = holds & gate if gate is not None else holds
    return F.coalesce(holds, F.lit(False))


def eligible_on(start: Column, end: Column, day: object | None) -> Column:
    """Without a day everything is eligible; with one, rows without any bound are not."""
    if day is None:
        return F.lit(True)
    return F.coalesce((start.isNotNull() | end.isNotNull()) & (start.isNull() | (start <= F.lit(day))) & (end.isNull() | (F.lit(day) < end)), F.lit(False))


def overlap(a: tuple[Column, Column], b: tuple[Column, Column], first: object, last: object) -> Column:
    """Whether two half-open intervals share an instant; null ends are open."""
    start = F.greatest(F.coalesce(a[0], F.lit(first)), F.coalesce(b[0], F.lit(first)))
    return start < F.least(F.coalesce(a[1], F.lit(last)), F.coalesce(b[1], F.lit(last)))


def latest_as_of(rows: DataFrame, keys: list[str], seq: str, value: str, last_seq: object | None = None) -> DataFrame:
    """keys and the value of the highest seq, no later than last_seq."""
    rows = rows if last_seq is None else rows.where(F.col(seq) <= F.lit(last_seq))
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def lifecycle(versions: DataFrame, withdrawn: DataFrame, version: str, supersedes: str, document: str) -> DataFrame:
    """versions with status: withdrawn (its document is), else superseded (a version names it), else active."""
    replaced = versions.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("replaced_id")).distinct()
    gone = withdrawn.select(F.col(document).alias("gone_id")).distinct()
    out = versions.join(replaced, F.col(version) == F.col("replaced_id"), "left").join(gone, F.col(document) == F.col("gone_id"), "left")
    status = F.when(F.col("gone_id").isNotNull(), "withdrawn").when(F.col("replaced_id").isNotNull(), "superseded").otherwise("active")
    return out.withColumn("status", status).drop("replaced_id", "gone_id")


def not_superseded(rows: DataFrame, item: str, supersedes: str) -> DataFrame:
    """Rows that no row's array of superseded ids names."""
    named = rows.select(F.explode(supersedes).alias("named_id")).distinct()
    return rows.join(named, F.col(item) == F.col("named_id"), "left_anti")


def _overlap_count(points: DataFrame, keys: list[str]) -> Column:
    """Of a start the negated number of intervals over by then, of an end the number begun before it."""
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    together = Window.partitionBy(*keys, "at")
    begun = F.sum("starts").over(upto) - F.sum("starts").over(together)
    return F.when(F.col("starts") == 1, -F.sum("ends").over(upto)).otherwise(begun)


def disputed(rows: DataFrame, group: str, item: str, claim: str, start: str, end: str) -> DataFrame:
    """item, disputed: whether another claim of the same exclusive group holds at a shared instant.

    No pairs are made: the intervals that a row overlaps are those begun before its end less those over by its start,
    and the row is disputed if there are more of them in the group than of its own claim. Null ends are open, null
    starts reach back without limit, empty intervals are left out; item is unique.
    """
    kind = rows.schema[start].dataType
    begin = F.coalesce(start, F.lit("0001-01-01").cast(kind))
    stop = F.coalesce(end, F.lit("9999-12-31").cast(kind))
    real = rows.where(begin < stop).select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(claim).alias("c"), begin.alias("b"), stop.alias("e"))
    points = real.select("g", "i", "c", F.explode(F.array(F.struct(F.col("b").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct(F.col("e").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))).alias("p")).select("g", "i", "c", "p.*")
    counted = points.withColumn("all_n", _overlap_count(points, ["g"])).withColumn("own_n", _overlap_count(points, ["g", "c"]))
    return counted.groupBy(F.col("i").alias(item)).agg((F.sum("all_n") > F.sum("own_n")).alias("disputed"))


def snapshot_changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change: added, removed, changed (any value differs, null included) or unchanged, in that order."""
    b = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("b_here"))
    a = after.select(*keys, *values, F.lit(True).alias("a_here"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    equal = reduce(Column.__and__, [F.col(v).eqNullSafe(F.col(f"b_{v}")) for v in values])
    change = F.when(F.col("b_here").isNull(), "added").when(F.col("a_here").isNull(), "removed").when(~equal, "changed").otherwise("unchanged")
    joined = a.join(b, same, "full_outer")
    return joined.select(*[F.coalesce(k, f"b_{k}").alias(k) for k in keys], change.alias("change"))


def chain_problems(versions: DataFrame, version: str, parent: str) -> DataFrame:
    """version, problem: missing_parent, or cycle for versions whose chain of parents comes back to them."""
    link = versions.where(F.col(parent).isNotNull()).select(F.col(version).alias("node"), F.col(parent).alias("parent"))
    known = versions.select(F.col(version).alias("known_id"))
    missing = link.join(known, F.col("parent") == F.col("known_id"), "left_anti").select(F.col("node").alias(version), F.lit("missing_parent").alias("problem"))
    return missing.union(cycles(link).select(F.col("node").alias(version), F.lit("cycle").alias("problem")))


def change_categories(before: DataFrame, after: DataFrame, item: str, status: str, value: str, available: str, ingested: str) -> DataFrame:
    """item and categories (joined by commas, in alphabetical order) of what differs between two knowledge states.

    new_support: a new item; late_evidence: its source was available before it was ingested; retraction: it is gone or
    withdrawn; correction: its value differs; assessment_change: its status differs otherwise.
    """
    b = before.select(F.col(item).alias("b_item"), F.col(status).alias("b_status"), F.col(value).alias("b_value"))
    both = after.join(b, F.col(item) == F.col("b_item"), "full_outer")
    new, gone = F.col("b_item").isNull(), F.col(item).isNull()
    withdrawn = ~new & (gone | ((F.col(status) == "withdrawn") & ~F.col("b_status").eqNullSafe(F.lit("withdrawn"))))
    found = {
        "assessment_change": ~new & ~gone & ~withdrawn & ~F.col(status).eqNullSafe(F.col("b_status")),
        "correction": ~new & ~gone & ~F.col(value).eqNullSafe(F.col("b_value")),
        "late_evidence": new & (F.col(available) < F.col(ingested)),
        "new_support": new,
        "retraction": withdrawn,
    }
    names = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(found.items())])), ",")
    return both.select(F.coalesce(item, "b_item").alias(item), names.alias("categories")).where("categories <> ''")


def knowledge_changes(before: DataFrame, after: DataFrame, item: str, supersedes: str, disputed: str, version: str, document: str, late: str, source_status: DataFrame, source_mode: bool = False) -> DataFrame:
    """item and categories (joined by commas, the leading one first) of what differs between two knowledge states.

    A new item is a correction of earlier ones that it supersedes (a processing_discovery, if all are of its own source
    version), else new_support; in source mode it is a source_revision if its document had items before. late_evidence
    and unresolved_conflict are added. The same item with other conflicts is unresolved_conflict or assessment_change. An
    item that is gone and not superseded is a retraction or a source_revision by the status of its source (document,
    status), else a coverage_change.
    """
    old = before.select(F.col(item).alias("old_item"), F.col(disputed).alias("old_disputed"), F.col(version).alias("old_version"), F.col(document).alias("old_document"))
    new = after.join(old.select("old_item"), F.col(item) == F.col("old_item"), "left_anti")
    if source_mode:
        prior = new.select(item, F.col(version).alias("own_version"), document).join(old, F.col(document) == F.col("old_document"))
    else:
        prior = new.select(item, F.col(version).alias("own_version"), F.explode(supersedes).alias("named")).join(old, F.col("named") == F.col("old_item"))
    lineage = prior.groupBy(F.col(item).alias("child")).agg(F.bool_and(F.col("old_version") == F.col("own_version")).alias("same_version"))
    kind = F.when(F.col("child").isNull(), "new_support").when(F.lit(source_mode), "source_revision").when(F.col("same_version"), "processing_discovery").otherwise("correction")
    extra = [F.when(F.col(late), "late_evidence"), F.when(F.col(disputed), "unresolved_conflict")]
    arrived = new.join(lineage, F.col(item) == F.col("child"), "left").select(item, F.array_join(F.array_compact(F.array(kind, *extra)), ",").alias("categories"))
    changed = after.join(old, F.col(item) == F.col("old_item")).where(~F.col(disputed).eqNullSafe(F.col("old_disputed"))).select(item, F.when(F.col(disputed), "unresolved_conflict").otherwise("assessment_change").alias("categories"))
    kept = after.select(F.col(item).alias("kept_item")).union(prior.select("old_item")).distinct()
    gone = before.join(kept, F.col(item) == F.col("kept_item"), "left_anti").join(source_status.select(F.col(document).alias("s_document"), F.col("status").alias("s_status")), F.col(document) == F.col("s_document"), "left")
    why = F.when(F.col("s_status") == "withdrawn", "retraction").when(F.col("s_status") == "superseded", "source_revision").otherwise("coverage_change")
    return arrived.union(changed).union(gone.select(item, why.alias("categories")))


def world_changes(before: DataFrame, after: DataFrame, item: str, group: str, modality: str, disputed: str) -> DataFrame:
    """group and categories of the groups that hold other items at the second instant than at the first:
    planned_transition if any item is planned, else world_state_change; unresolved_conflict is added if any is disputed."""
    sides = [df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(modality) == "planned").alias("planned"), F.col(disputed).alias("disputed"), F.lit(n).alias("side")) for n, df in ((1, before), (2, after))]
    each = sides[0].union(sides[1]).groupBy("g", "i").agg(F.countDistinct("side").alias("sides"), F.bool_or("planned").alias("planned"), F.bool_or("disputed").alias("disputed"))
    groups = each.groupBy("g").agg(F.min("sides").alias("sides"), F.bool_or("planned").alias("planned"), F.bool_or("disputed").alias("disputed")).where("sides = 1")
    kind = F.when(F.col("planned"), "planned_transition").otherwise("world_state_change")
    return groups.select(F.col("g").alias(group), F.array_join(F.array_compact(F.array(kind, F.when(F.col("disputed"), "unresolved_conflict"))), ",").alias("categories"))
