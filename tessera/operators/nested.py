"""Statements in nested documents of any shape, read from VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMITTED = "admitted"


def statements_of(rows: DataFrame, item: str, document: Column, path: str = "$.claims") -> DataFrame:
    """item, property, number (from 0), rank, kind, type, value, ended, outcome of every statement in the documents.

    document: JSON text with an object at `path` that holds an array of statements for each property; a statement is
    {"rank", "mainsnak": {"snaktype", "datavalue": {"type", "value"}}, "qualifiers": {property: ...}}. outcome: admitted,
    or why a statement is left out: deprecated_rank, no_value, unknown_value, without_datavalue, has_ended. A document
    that can't be parsed, or has no such object, has no statements.
    """
    whole = rows.select(item, F.try_variant_get(F.try_parse_json(document), path, "variant").alias("claims"))
    properties = whole.lateralJoin(whole.sparkSession.tvf.variant_explode(F.col("claims").outer())).select(item, F.col("key").alias("property"), F.col("value").alias("own")).where("property is not null")
    each = properties.lateralJoin(properties.sparkSession.tvf.variant_explode(F.col("own").outer())).where("key is null and pos is not null")

    def text(at: str) -> Column:
        return F.try_variant_get("value", at, "string")

    rank, kind = F.coalesce(text("$.rank"), F.lit("normal")), text("$.mainsnak.snaktype")
    ended = F.try_variant_get("value", "$.qualifiers.end", "variant").isNotNull()
    value = text("$.mainsnak.datavalue.value")
    outcome = (
        F.when(rank == "deprecated", "deprecated_rank").when(kind == "novalue", "no_value").when(kind == "somevalue", "unknown_value")
        .when(value.isNull(), "without_datavalue").when(ended, "has_ended").otherwise(ADMITTED)
    )
    return each.select(item, "property", F.col("pos").alias("number"), rank.alias("rank"), kind.alias("kind"), text("$.mainsnak.datavalue.type").alias("type"), value.alias("value"), ended.alias("ended"), outcome.alias("outcome"))


def evidence_of(found: DataFrame, item: str, known: dict[str, str]) -> DataFrame:
    """item, predicate, value, preferred of the admitted statements whose property is known (property -> predicate); where
    an item has statements of preferred rank for a property, only those."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("property"))
    rows = found.where(F.col("outcome") == ADMITTED).withColumn("predicate", named).where("predicate is not null")
    preferred = F.col("rank") == "preferred"
    best = rows.groupBy(F.col(item).alias("of_item"), F.col("property").alias("of_property")).agg(F.max(preferred).alias("some"))
    kept = rows.join(best, (F.col(item) == F.col("of_item")) & (F.col("property") == F.col("of_property"))).where(preferred | ~F.col("some"))
    return kept.select(item, "predicate", "value", preferred.alias("preferred"))
