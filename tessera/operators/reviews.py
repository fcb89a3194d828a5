"""Append-only reviews: which decisions stand, what they change, what a withdrawal makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standing(events: DataFrame, event: str, undoes: str) -> DataFrame:
    """Events that no other event undoes; undo events themselves are left out."""
    undone = events.where(F.col(undoes).isNotNull()).select(F.col(undoes).alias("undone_id"))
    return events.where(F.col(undoes).isNull()).join(undone, F.col(event) == F.col("undone_id"), "left_anti")


def latest_decisions(events: DataFrame, subject: str, seq: str, values: list[str]) -> DataFrame:
    """subject and the values of its event with the highest seq."""
    return events.groupBy(subject).agg(F.max_by(F.struct(*values), seq).alias("latest")).select(subject, "latest.*")


def review_states(items: DataFrame, decisions: DataFrame, item: str, fingerprint: str) -> DataFrame:
    """items with review_state: unreviewed, stale (the item changed since) or the decision."""
    d = decisions.select(F.col(item).alias("d_item"), F.col("decision").alias("d_decision"), F.col("reviewed_print").alias("d_print"))
    state = F.when(F.col("d_item").isNull(), "unreviewed").when(~F.col("d_print").eqNullSafe(F.col(fingerprint)), "stale").otherwise(F.col("d_decision"))
    return items.join(d, F.col(item) == F.col("d_item"), "left").withColumn("review_state", state).drop("d_item", "d_decision", "d_print")


def corrected(items: DataFrame, corrections: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """items with the columns that a correction (at most one row an item) states."""
    c = corrections.select(F.col(item).alias("c_item"), *[F.col(x).alias(f"c_{x}") for x in columns])
    joined = items.join(c, F.col(item) == F.col("c_item"), "left")
    return joined.withColumns({x: F.coalesce(f"c_{x}", x) for x in columns}).drop("c_item", *[f"c_{x}" for x in columns])


def stale_by_withdrawal(assertions: DataFrame, item: str, evidence: str, withdrawn: DataFrame, withdrawn_id: str) -> DataFrame:
    """item, lost (pieces of evidence that are withdrawn), stale (some are), baseless (all are)."""
    gone = withdrawn.select(F.col(withdrawn_id).alias("gone_id")).distinct()
    cited = assertions.select(item, F.explode(F.array_distinct(evidence)).alias("cited_id"))
    n_lost = F.count("gone_id")
    return cited.join(gone, F.col("cited_id") == F.col("gone_id"), "left").groupBy(item).agg(n_lost.alias("lost"), (n_lost > 0).alias("stale"), (n_lost == F.count(F.lit(1))).alias("baseless"))


def redacted(available: Column, text: Column) -> Column:
    """The text while its source is available, else null."""
    return F.when(available, text)


def permitted(items: DataFrame, item: str, revoked: DataFrame, revoked_id: str) -> DataFrame:
    return items.join(revoked.select(F.col(revoked_id).alias("revoked")).distinct(), F.col(item) == F.col("revoked"), "left_anti")
