"""Relations that hold for a time: the parent in force at each moment, and cycles of parents over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settled

FIRST, LAST = "0001-01-01", "9999-12-31"


def closed_dates(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows with lo and hi: the days from which and until before which they hold; null ends are open."""
    lo, hi = F.coalesce(F.col(start), F.lit(FIRST).cast("date")), F.coalesce(F.col(end), F.lit(LAST).cast("date"))
    return rows.withColumns({"lo": lo, "hi": hi}).where("lo < hi")


def parents_in_force(candidates: DataFrame, child: str, parent: str, priority: str, score: str, start: str, end: str, documented: int = 1, threshold: float = 0.55, margin: float = 0.08) -> DataFrame:
    """child, parent, lo, hi: the parent that each child has from day lo until before day hi, where it has one.

    The time of a child is cut at the bounds of its candidates. In each piece the candidates of the smallest priority
    number count: up to `documented` they must name one parent, beyond it the best score must reach the threshold and
    lead by the margin that of any other parent. A child is never its own parent.
    """
    rows = closed_dates(candidates.where(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent))), start, end)
    rows = rows.select(F.col(child).alias("child"), F.col(parent).alias("parent"), F.col(priority).alias("priority"), F.coalesce(F.col(score), F.lit(0.0)).alias("score"), "lo", "hi")
    cuts = rows.select("child", F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    pieces = cuts.withColumn("hi", F.lead("lo").over(Window.partitionBy("child").orderBy("lo"))).where("hi is not null")
    p = pieces.select(F.col("child").alias("c"), F.col("lo").alias("from"), F.col("hi").alias("until"))
    held = rows.join(p, (F.col("child") == F.col("c")) & (F.col("lo") <= F.col("from")) & (F.col("until") <= F.col("hi"))).select("child", "parent", "priority", "score", "from", "until")
    piece = ["child", "from", "until"]
    rated = held.groupBy(*piece, "priority", "parent").agg(F.max("score").alias("score"))
    first = F.min("priority").over(Window.partitionBy(*piece))
    best = Window.partitionBy(*piece).orderBy(F.desc("score"), "parent")
    top = rated.withColumn("first_priority", first).where("priority = first_priority").withColumns({"place": F.row_number().over(best), "next": F.lead("score").over(best)}).where("place = 1")
    alone = F.col("next").isNull()
    sure = F.when(F.col("priority") <= documented, alone).otherwise((F.col("score") >= threshold) & (alone | (F.col("score") - F.col("next") >= margin)))
    return merged(top.where(sure).select("child", "parent", F.col("from").alias("lo"), F.col("until").alias("hi")), ["child", "parent"])


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi: overlapping and adjoining intervals of one key as one."""
    own = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    islands = rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(own))
    return islands.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def cycles_over_time(parents: DataFrame) -> DataFrame:
    """node, lo, hi: the longest spans in which a node is on a cycle of parents. parents: child, parent, lo, hi, where a
    child has one parent at a time.

    A pointer goes from a node to a node above it for a span of days; joined with the pointer that goes on from there, it
    holds where both do. Their reach doubles each round, and time is cut only where the parents above a node change. After
    as many steps as there are nodes a pointer has ended or stands on a cycle, and all of a cycle is stood on.
    """
    reach = settled(parents.select(F.col("child").alias("node"), F.col("parent").alias("at"), "lo", "hi"), "reach")
    n, steps = reach.select("node").distinct().count(), 1
    while steps < n and not reach.isEmpty():
        step = reach.select(F.col("node").alias("mid"), F.col("at").alias("up"), F.col("lo").alias("from"), F.col("hi").alias("until"))
        both = reach.join(step, (F.col("at") == F.col("mid")) & (F.col("from") < F.col("hi")) & (F.col("lo") < F.col("until")))
        far = both.select("node", F.col("up").alias("at"), F.greatest("lo", "from").alias("lo"), F.least("hi", "until").alias("hi"))
        reach, steps = settled(merged(far, ["node", "at"]), "reach"), steps * 2
    return merged(reach.select(F.col("at").alias("node"), "lo", "hi").distinct(), ["node"])


def closes_cycle(parents: DataFrame, proposed: DataFrame, child: str, parent: str, start: str, end: str) -> DataFrame:
    """proposed with in_cycle: whether it would be on a cycle for some day of its time if it took the place of the child's
    other parents then. Proposals are judged one by one, so they walk up together but never meet.

    Each walk is a span of days at a node above the child; a round moves all walks one parent up, so there are as many
    rounds as the deepest ancestry has steps. A walk that comes back to its child is a cycle; one that only meets a cycle
    above it ends where it was before.
    """
    rows = settled(closed_dates(proposed.withColumn("of_proposal", F.monotonically_increasing_id()), start, end), "proposed")
    walk = rows.select("of_proposal", F.col(child).alias("from_child"), F.col(parent).alias("at"), "lo", "hi").where("at is not null and from_child is not null")
    seen, found = None, None
    step = parents.select(F.col("child").alias("mid"), F.col("parent").alias("up"), F.col("lo").alias("from"), F.col("hi").alias("until"))
    while True:
        walk = settled(walk, "walks")
        back = walk.where("at = from_child").select("of_proposal")
        found = back if found is None else found.union(back)
        going = walk.where("at <> from_child")
        if going.isEmpty():
            break
        seen = going if seen is None else settled(seen.union(going), "seen")
        both = going.join(step, (F.col("at") == F.col("mid")) & (F.col("from") < F.col("hi")) & (F.col("lo") < F.col("until")))
        moved = both.select("of_proposal", "from_child", F.col("up").alias("at"), F.greatest("lo", "from").alias("lo"), F.least("hi", "until").alias("hi")).distinct()
        been = seen.select(F.col("of_proposal").alias("p"), F.col("at").alias("been"), F.col("lo").alias("been_from"), F.col("hi").alias("been_until"))
        covered = (F.col("of_proposal") == F.col("p")) & (F.col("at") == F.col("been")) & (F.col("been_from") <= F.col("lo")) & (F.col("hi") <= F.col("been_until"))
        walk = moved.join(been, covered, "left_anti")
    hit = found.distinct().withColumnRenamed("of_proposal", "hit")
    return rows.join(hit, F.col("of_proposal") == F.col("hit"), "left").withColumn("in_cycle", F.col("hit").isNotNull()).drop("of_proposal", "hit", "lo", "hi")


def days(lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    return F.datediff(hi, lo)
