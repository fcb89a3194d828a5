"""Communities of weighted graphs by modularity on Spark, and how stable they are when edges are lost.

Single nodes move between communities, then whole communities join others, level by level, then single nodes move again,
until nothing gains. All nodes look for their best move at once, and a round makes so many of the moves that their gains
add up: a community either gives or takes in a round, whichever gains more; it gives one node at most, and takes its
candidates in the order of their gains as long as each still gains when all those before it have come. So modularity
rises with every move. Several graphs (column run) go through the same jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settled

#: Gains below this share of all weight are rounding.
LEAST_GAIN = 1e-12


def symmetric(edges: DataFrame, a: str, b: str, weight: str, run: Column) -> DataFrame:
    """run, u, v, w: each edge in both directions, weights of repeated ones summed; without loops, nulls and weights
    that aren't positive."""
    rows = edges.select(run.alias("run"), F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).cast("double").alias("w")).where("u <> v and w > 0")
    return rows.union(rows.select("run", "v", "u", "w")).groupBy("run", "u", "v").agg(F.sum("w").alias("w"))


def moved(nodes: DataFrame, links: DataFrame, halves: Column, number: int) -> tuple[DataFrame, int]:
    """nodes (run, node, k, com) after one round, and how many have moved.

    links: run, u, v, w in both directions; halves: the weight of all links of a run, each once. The best move of all is
    always made, but for ties; those are settled by a hash of the round's number.
    """
    own = nodes.select("run", F.col("node").alias("u"), "k", "com")
    totals = nodes.groupBy("run", "com").agg(F.sum("k").alias("tot"))
    toward = links.join(nodes.select("run", F.col("node").alias("v"), F.col("com").alias("to")), ["run", "v"]).groupBy("run", "u", "to").agg(F.sum("w").alias("w"))
    rows = toward.join(own, ["run", "u"])
    inside = F.max(F.when(F.col("to") == F.col("com"), F.col("w"))).over(Window.partitionBy("run", "u"))
    away = rows.withColumn("w_own", F.coalesce(inside, F.lit(0.0))).where("to <> com")
    away = away.join(totals.select("run", F.col("com").alias("to"), F.col("tot").alias("tot_to")), ["run", "to"]).join(totals, ["run", "com"])
    m = halves
    gain = (F.col("w") - F.col("w_own")) / m - F.col("k") * (F.col("tot_to") - F.col("tot") + F.col("k")) / (2 * m * m)
    gains = away.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    one = gains.groupBy("run", "com").agg(F.max(F.struct("gain", F.xxhash64("to", F.lit(number)).alias("tie"), "u", "k", "to")).alias("x")).select("run", "com", "x.*")
    into = one.groupBy("run", F.col("to").alias("com")).agg(F.max("gain").alias("in_gain"))
    role = one.select("run", "com", "gain").join(into, ["run", "com"], "full_outer")
    out, come = F.coalesce("gain", F.lit(0.0)), F.coalesce("in_gain", F.lit(0.0))
    takes = (come > out) | ((come == out) & (F.pmod(F.xxhash64("com", F.lit(number)), F.lit(2)) == 0))
    role = role.select("run", "com", takes.alias("takes"))
    fit = one.join(role.where("not takes").select("run", "com"), ["run", "com"], "left_semi").join(role.where("takes").select("run", F.col("com").alias("to")), ["run", "to"], "left_semi")
    before = F.coalesce(F.sum("k_moved").over(Window.partitionBy("run", "to").orderBy(F.desc("gain"), "u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.col("gain") - F.col("k_moved") * before / (2 * m * m)
    taken = fit.withColumnRenamed("k", "k_moved").withColumn("left", left).where(F.col("left") > LEAST_GAIN).select("run", F.col("u").alias("node"), "to")
    new = nodes.join(taken, ["run", "node"], "left").select("run", "node", "k", F.coalesce("to", "com").alias("com"), F.col("to").isNotNull().alias("moved"))
    new = settled(new, "communities")
    return new.drop("moved"), new.where("moved").count()


def rounds_of(nodes: DataFrame, links: DataFrame, halves: Column, rounds: int, first: int) -> tuple[DataFrame, int]:
    """nodes after at most `rounds` rounds, or two in which none moves; and the number of moves."""
    total, idle = 0, 0
    for i in range(rounds):
        nodes, n = moved(nodes, links, halves, first + i)
        total, idle = total + n, 0 if n else idle + 1
        if idle == 2:
            break
    return nodes, total


def communities(edges: DataFrame, a: str, b: str, weight: str, runs: list[Column] | None = None, rounds: int = 16, levels: int = 12, cycles: int = 4) -> DataFrame:
    """run, node, community (its smallest node): communities of high modularity. Every node of an edge that is in any run
    is in each of them, alone if that run has no edge of it.

    runs: conditions on the edges, one for each graph (run 0, 1, ...); without, all edges are one graph. Repeated edges
    count together, in both directions; loops, nulls and edges without a positive weight don't count. rounds, levels and
    cycles bound the search, not its result: a run that ends early is only less good.
    """
    runs = runs or [F.lit(True)]
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(runs)])))
    links = settled(symmetric(edges.withColumn("of_run", each), a, b, weight, F.col("of_run")), "links")
    sums = {r["run"]: r["w"] / 2 for r in links.groupBy("run").agg(F.sum("w").alias("w")).collect()}  # a row for each run
    everyone = links.select("u").distinct().select(F.explode(F.lit(list(range(len(runs))))).alias("run"), F.col("u").alias("node"))
    if not sums:
        return everyone.withColumn("community", F.col("node"))
    halves = F.element_at(F.create_map(*[F.lit(x) for kv in sums.items() for x in kv]), F.col("run"))
    nodes = settled(links.groupBy("run", F.col("u").alias("node")).agg(F.sum("w").alias("k")).withColumn("com", F.col("node")), "communities")
    number = 0
    for _ in range(cycles):
        nodes, gained = rounds_of(nodes, links, halves, rounds, number)
        for _ in range(levels):
            number += rounds
            of = nodes.select("run", F.col("node").alias("u"), F.col("com").alias("cu"))
            ends = links.join(of, ["run", "u"]).join(of.select("run", F.col("u").alias("v"), F.col("cu").alias("cv")), ["run", "v"])
            between = settled(ends.where("cu <> cv").groupBy("run", F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "links")
            whole = nodes.groupBy("run", F.col("com").alias("node")).agg(F.sum("k").alias("k")).withColumn("com", F.col("node"))
            whole, n = rounds_of(settled(whole, "communities"), between, halves, rounds, number)
            if not n:
                break
            gained += n
            up = whole.select("run", F.col("node").alias("com"), F.col("com").alias("up"))
            nodes = settled(nodes.join(up, ["run", "com"]).select("run", "node", "k", F.col("up").alias("com")), "communities")
        number += rounds
        if not gained:
            break
    names = nodes.groupBy("run", "com").agg(F.min("node").alias("community"))
    placed = nodes.join(names, ["run", "com"]).select("run", "node", "community")
    return everyone.join(placed, ["run", "node"], "left").select("run", "node", F.coalesce("community", "node").alias("community"))


def modularity(edges: DataFrame, a: str, b: str, weight: str, members: DataFrame) -> float:
    """The modularity of members (node, community) of a graph; 0 without edges."""
    links = symmetric(edges, a, b, weight, F.lit(0))
    of = members.select("node", "community")
    ends = links.join(of.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(of.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    parts = ends.groupBy("cu").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    found = parts.agg(F.sum("inside").alias("i"), F.sum("tot").alias("t"), F.sum(F.col("tot") * F.col("tot")).alias("s")).first()
    return found["i"] / found["t"] - found["s"] / found["t"] ** 2 if found["t"] else 0.0


def stability(members: DataFrame) -> DataFrame:
    """community, members, mean_best_jaccard: for each community of at least two nodes in run 0, the mean over the other
    runs of its overlap with the community there that it is most like. members: run, node, community."""
    base = members.where("run = 0").select("node", "community")
    sizes = base.groupBy("community").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    others = members.where("run > 0").select("run", "node", F.col("community").alias("other"))
    other_sizes = others.groupBy("run", "other").agg(F.count(F.lit(1)).alias("other_members"))
    shared = base.join(others, "node").groupBy("community", "run", "other").agg(F.count(F.lit(1)).alias("both"))
    rated = shared.join(sizes, "community").join(other_sizes, ["run", "other"])
    like = rated.withColumn("j", F.col("both") / (F.col("members") + F.col("other_members") - F.col("both")))
    return like.groupBy("community", "members", "run").agg(F.max("j").alias("j")).groupBy("community", "members").agg(F.round(F.avg("j"), 4).alias("mean_best_jaccard"))


def kept_edges(a: str, b: str, repeats: int = 3, keep: float = 0.8, seed: int = 101) -> list[Column]:
    """Conditions for `communities`: all edges, and `repeats` samples in which an edge stays with probability `keep`, by a
    hash of its ends whichever way round they are."""
    low, high = F.least(a, b), F.greatest(a, b)
    return [F.lit(True), *[F.pmod(F.xxhash64(low, high, F.lit(seed + i)), F.lit(1 << 20)) < int(keep * (1 << 20)) for i in range(repeats)]]


def stable_communities(edges: DataFrame, a: str, b: str, weight: str, runs: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Communities (node, community) of the whole graph, and their stability when edges are dropped (see kept_edges)."""
    members = settled(communities(edges, a, b, weight, runs or kept_edges(a, b)), "members")
    return members.where("run = 0").select("node", "community"), stability(members)


__all__ = ["communities", "kept_edges", "modularity", "stability", "stable_communities"]
