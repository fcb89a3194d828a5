"""Communication metrics and relationship scores from messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RECIPIENTS = 20


def usable(messages: DataFrame, message: str, sender: str, to: str, sent: str, as_of: object, order: list[Column]) -> DataFrame:
    """First copy of each message id, sent by as_of, with a sender and at most MAX_RECIPIENTS distinct recipients."""
    first = F.row_number().over(Window.partitionBy(message).orderBy(*order))
    return messages.withColumn("copy", first).where((F.col("copy") == 1) & F.col(sender).isNotNull() & (F.size(F.array_distinct(to)) <= MAX_RECIPIENTS) & (F.col(sent).isNull() | (F.col(sent) <= F.lit(as_of)))).drop("copy")


def directed_pairs(messages: DataFrame, sender: str, recipient: str) -> DataFrame:
    """sender, recipient, sent of different people."""
    return messages.where(F.col(sender) != F.col(recipient)).groupBy(F.col(sender).alias("a"), F.col(recipient).alias("b")).agg(F.count(F.lit(1)).alias("sent"))


def undirected_pairs(pairs: DataFrame) -> DataFrame:
    """low, high, total, reciprocity (the smaller direction over the larger)."""
    out = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    up, down = F.sum(F.when(F.col("a") < F.col("b"), F.col("sent")).otherwise(0)), F.sum(F.when(F.col("a") > F.col("b"), F.col("sent")).otherwise(0))
    return out.agg(F.sum("sent").alias("total"), (F.least(up, down) / F.greatest(up, down)).alias("reciprocity"))


def person_metrics(pairs: DataFrame) -> DataFrame:
    """person, sent, received, breadth (distinct contacts)."""
    out = pairs.select(F.col("a").alias("person"), F.col("b").alias("contact"), F.col("sent"), F.lit(0).cast("long").alias("received"))
    into = pairs.select(F.col("b"), F.col("a"), F.lit(0).cast("long"), F.col("sent"))
    return out.union(into).groupBy("person").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.countDistinct("contact").alias("breadth"))


def top_contacts(pairs: DataFrame, most: int = 8) -> DataFrame:
    """person, contact, traffic, place: the contacts with most traffic in both directions, ties by contact."""
    both = pairs.select(F.col("a").alias("person"), F.col("b").alias("contact"), "sent").union(pairs.select("b", "a", "sent"))
    traffic = both.groupBy("person", "contact").agg(F.sum("sent").alias("traffic"))
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("traffic"), "contact"))
    return traffic.withColumn("place", place).where(F.col("place") <= most)


def contact_score(share: Column, reciprocity: Column, messages: Column) -> Column:
    """At most 0.52: what traffic alone can say."""
    return F.least(F.lit(0.52), 0.08 + 0.20 * share + 0.14 * reciprocity + 0.10 * F.least(F.lit(1.0), F.log1p(messages.cast("double")) / F.log(F.lit(11.0))))


def statement_score(statements: Column, messages: Column, denied: Column) -> Column:
    """At most 0.96: what people say themselves, 0.30 at most if one denies it."""
    score = F.least(F.lit(0.96), 0.88 + 0.02 * F.least(F.lit(2), statements - 1) + 0.04 * F.least(F.lit(1.0), messages / 4))
    return F.when(denied, F.least(score, F.lit(0.30))).otherwise(score)


def unquoted_lines(messages: DataFrame, message: str, body: str) -> DataFrame:
    """message, line_no, line of what the sender wrote: no `>` lines, nothing after a header of a quoted message."""
    lines = messages.select(message, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    header = F.col("line").rlike(r"(?i)^\s*(-+\s*(original|forwarded) message|on .+ wrote:\s*$|from:\s)").cast("int")
    quoted = F.max(header).over(Window.partitionBy(message).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("quoted", quoted).where((F.col("quoted") == 0) & ~F.col("line").rlike(r"^\s*>")).drop("quoted")


def alias_matches(mentions: DataFrame, alias: str, aliases: DataFrame, name: str, person: str) -> DataFrame:
    """mentions with the person whose alias they are, where exactly one person has it."""
    key = F.lower(F.trim(F.regexp_replace(F.col(name), r"\s+", " ")))
    unique = aliases.groupBy(key.alias("alias_key")).agg(F.min(person).alias(person), F.countDistinct(person).alias("people")).where("people = 1").drop("people")
    own = F.lower(F.trim(F.regexp_replace(F.col(alias), r"\s+", " ")))
    return mentions.join(unique, own == F.col("alias_key")).drop("alias_key")
