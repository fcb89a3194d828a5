"""Bounded traversal, hubs, forests and components on edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settled

MAX_HOPS = 10


def reachable(edges: DataFrame, seeds: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, hop: nodes at most `hops` directed steps from the seeds (column node), each at its shortest distance.
    A frontier join for each hop; visited nodes are left out, so cycles end."""
    if not 0 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must be 0 to {MAX_HOPS}")
    link = edges.select(F.col(src).alias("from_node"), F.col(dst).alias("to_node")).distinct()
    visited = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, hops + 1):
        step = frontier.join(link, F.col("node") == F.col("from_node")).select(F.col("to_node").alias("node")).distinct()
        frontier = settled(step.join(visited.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited


def edges_from(edges: DataFrame, reached: DataFrame, hops: int, src: str = "src") -> DataFrame:
    """The edges that leave nodes reached in fewer than `hops` steps."""
    inner = reached.where(F.col("hop") < hops).select(F.col("node").alias("inner_node"))
    return edges.join(inner, F.col(src) == F.col("inner_node"), "left_semi")


def endpoints(assertions: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """item, node: each assertion under each of its distinct endpoints."""
    return assertions.select(item, F.explode(F.array_distinct(F.array(a, b))).alias("node"))


def hubs(assertions: DataFrame, item: str, a: str, b: str, top: int, labels: DataFrame | None = None) -> DataFrame:
    """node, degree of the best connected nodes; ties by label without case, where labels (node, label) are given, then
    by node."""
    found = endpoints(assertions, item, a, b).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    if labels is None:
        return found.orderBy(F.desc("degree"), "node").limit(top)
    named = found.join(labels.groupBy("node").agg(F.min("label").alias("label")), "node", "left")
    return named.orderBy(F.desc("degree"), F.asc_nulls_last(F.lower("label")), "node").limit(top)


def per_node(edges: DataFrame, node: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` edges of each node, in order."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy(node).orderBy(*order))).where(F.col("place") <= most)


def cycles(link: DataFrame) -> DataFrame:
    """node, cycle (its smallest node) for the nodes on a cycle of node -> parent, one parent each.

    The reach of the pointers doubles each round. After at least as many steps as there are nodes a chain either has
    ended or stands on a cycle, and every node of a cycle is stood on.
    """
    n = link.count()
    reach = link.select(F.col("node"), F.col("parent").alias("at"), F.least("node", "parent").alias("low"))
    reach, steps = settled(reach, "reach"), 1
    while steps < n and not reach.isEmpty():
        step = reach.select(F.col("node").alias("mid"), F.col("at").alias("next_at"), F.col("low").alias("next_low"))
        reach = settled(reach.join(step, F.col("at") == F.col("mid")).select("node", F.col("next_at").alias("at"), F.least("low", "next_low").alias("low")), "reach")
        steps *= 2
    # Self-references are cycles of one; a chain that leads into a cycle carries its own smaller nodes, so the cycle's
    # smallest is taken from the nodes that are stood on.
    standing = reach.select(F.col("at").alias("node")).distinct() if n else reach.select("node")
    return standing.join(reach.select("node", "low"), "node").select("node", F.col("low").alias("cycle"))


def forest(candidates: DataFrame, child: str, parent: str, priority: str, score: str) -> DataFrame:
    """child, parent, status: one parent for each child, without cycles.

    The candidate with the smallest priority number and, there, the highest score is chosen (ties: the smaller
    parent). Of each cycle the edge that comes last by (priority, -score, child) is dropped: its status is
    cycle_conflict and its parent null.
    """
    best = Window.partitionBy(child).orderBy(priority, F.desc(score), parent)
    chosen = settled(candidates.withColumn("place", F.row_number().over(best)).where("place = 1").select(child, parent, priority, score), "chosen")
    ring = cycles(chosen.select(F.col(child).alias("node"), F.col(parent).alias("parent")))
    rank = F.row_number().over(Window.partitionBy("cycle").orderBy(F.desc(priority), F.asc(score), F.desc(child)))
    cut = ring.join(chosen, F.col("node") == F.col(child)).withColumn("place", rank).where("place = 1").select(F.col("node").alias("cut_node"))
    out = chosen.join(cut, F.col(child) == F.col("cut_node"), "left")
    dropped = F.col("cut_node").isNotNull()
    return out.select(child, F.when(~dropped, F.col(parent)).alias(parent), F.when(dropped, "cycle_conflict").otherwise("selected").alias("status"))


def projected(people: DataFrame, person: str, candidates: DataFrame, rejected: DataFrame, documented: int = 1, threshold: float = 0.55, margin: float = 0.08) -> DataFrame:
    """person, parent, status for each row of people: a forest of at most one parent each, or why there is none.

    candidates: child, parent, priority (0: decided, up to `documented`: from sources, beyond: scored), score, barred (why
    it can't count, or null); rejected: child, those for whom a review refused a parent. Of a person's candidates those of
    the smallest priority count: decided ones at once (ties: the smaller parent), sources if they name one parent, scores
    if the best reaches the threshold and leads that of another parent by the margin. Statuses: selected, cycle_conflict
    (see forest), analyst_rejected, conflicting_sources, weak_evidence, close_alternatives; without a candidate that
    counts, the last in the alphabet of why they don't, or insufficient_evidence. Candidates of or for unknown people, or
    of a person as its own parent, don't count.
    """
    known = people.select(F.col(person).alias("known_id"))
    real = candidates.where("child <> parent").join(known, F.col("child") == F.col("known_id"), "left_semi").join(known, F.col("parent") == F.col("known_id"), "left_semi")
    rated = real.where("barred is null").groupBy("child", "priority", "parent").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("child").orderBy(F.desc("score"), "parent")
    top = rated.withColumn("first_priority", F.min("priority").over(Window.partitionBy("child"))).where("priority = first_priority")
    top = top.withColumns({"place": F.row_number().over(best), "next_score": F.lead("score").over(best)}).where("place = 1")
    several = F.col("next_score").isNotNull()
    doubt = (
        F.when((F.col("priority") > 0) & (F.col("priority") <= documented) & several, "conflicting_sources")
        .when((F.col("priority") > documented) & (F.col("score") < threshold), "weak_evidence")
        .when((F.col("priority") > documented) & several & (F.col("score") - F.col("next_score") < margin), "close_alternatives")
    )
    refused = rejected.select(F.col("child").alias("refused_id")).distinct()
    judged = settled(top.withColumn("doubt", doubt).join(refused, F.col("child") == F.col("refused_id"), "left_anti"), "judged")
    placed = forest(judged.where("doubt is null").select("child", "parent", "priority", "score"), "child", "parent", "priority", "score")
    doubts = judged.where("doubt is not null").select("child", F.lit(None).cast(placed.schema["parent"].dataType).alias("parent"), F.col("doubt").alias("status"))
    found = placed.union(doubts).withColumnRenamed("child", "of_person")
    barred = real.where("barred is not null").groupBy(F.col("child").alias("barred_id")).agg(F.max("barred").alias("barred"))
    out = people.select(F.col(person).alias("person")).join(found, F.col("person") == F.col("of_person"), "left").join(barred, F.col("person") == F.col("barred_id"), "left").join(refused, F.col("person") == F.col("refused_id"), "left")
    status = F.when(F.col("refused_id").isNotNull(), "analyst_rejected").otherwise(F.coalesce("status", "barred", F.lit("insufficient_evidence")))
    return out.select("person", "parent", status.alias("status"))


def neighbourhood(edges: DataFrame, edge: str, a: str, b: str, node: object, hops: int = 1, per_node: int = 50, most_edges: int = 500) -> tuple[DataFrame, set[str]]:
    """edge, hop of the edges around one node, at most `hops` steps away, within the bounds of `expanded`; its own edges
    have hop 0. An unknown node has none."""
    if hops < 1:
        raise ValueError("hops must be 1 at least")
    own = edges.where((F.col(a) == F.lit(node)) | (F.col(b) == F.lit(node))).select(edge, F.lit(0.0).alias("score")).orderBy(edge).limit(per_node + 1)
    own = settled(own, "own-edges")
    cut = own.count() > per_node
    found, reasons = expanded(edges, edge, a, b, own.orderBy(edge).limit(per_node), hops - 1, per_node, most_edges)
    return found, reasons | ({"per_node_budget"} if cut else set())


def ancestors(tree: DataFrame, child: str, parent: str, most: int | None = None) -> DataFrame:
    """node, ancestor, steps for all ancestors, or those at most `most` steps up; pointers double each round, so there
    are as many rounds as the logarithm of the depth. A cycle is an error unless `most` bounds the walk."""
    link = tree.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"))
    closure = jump = settled(link, "closure")
    limit = closure.count() + 1 if most is None else most
    reach = 1
    while reach < limit:
        step = jump.select(F.col("node").alias("mid"), F.col("ancestor").alias("up"), F.col("steps").alias("more"))
        farther = closure.join(step, F.col("ancestor") == F.col("mid")).select("node", F.col("up").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        grown = settled(farther, "farther")
        if grown.isEmpty():
            return closure if most is None else closure.where(F.col("steps") <= most)
        closure = settled(closure.union(grown), "closure")
        jump = settled(jump.join(step, F.col("ancestor") == F.col("mid")).select("node", F.col("up").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps")), "jump")
        reach *= 2
    if most is None and not jump.isEmpty():
        raise ValueError("the tree has a cycle")
    return closure if most is None else closure.where(F.col("steps") <= most)


def subtree_sizes(tree: DataFrame, child: str, parent: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """node, subtree (nodes below and itself), depth (of the deepest below) and the sums of the numeric columns `sums`
    of tree over the subtree, for every node of a forest, however deep.

    Pointers double each round: a node knows the nodes fewer than `reach` steps below it and gives their number and
    depth to the node `reach` steps up, until no pointer is left. A cycle is an error.
    """
    own = [f"sum_{i}" for i in range(len(sums))]
    rows = tree.select(F.col(child).alias("node"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(o) for c, o in zip(sums, own, strict=True)])
    above = tree.where(F.col(parent).isNotNull()).select(F.col(parent).alias("node"), *[F.lit(0).cast("long").alias(o) for o in own])
    nodes = rows.union(above).groupBy("node").agg(F.lit(1).cast("long").alias("subtree"), F.lit(0).alias("depth"), *[F.sum(o).alias(o) for o in own])
    known = settled(nodes, "subtrees")
    jump = settled(tree.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("up")), "jump")
    n, reach = known.count(), 1
    while not jump.isEmpty():
        if reach >= n:
            raise ValueError("the tree has a cycle")
        added = {c: f"more_{c}" for c in ("subtree", *own)}
        given = jump.join(known, "node").groupBy("up").agg((F.max("depth") + reach).alias("deeper"), *[F.sum(c).alias(m) for c, m in added.items()])
        grown = known.join(given, F.col("node") == F.col("up"), "left")
        total = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in added.items()]
        known = settled(grown.select("node", F.greatest("depth", F.coalesce("deeper", "depth")).cast("int").alias("depth"), *total), "subtrees")
        step = jump.select(F.col("node").alias("mid"), F.col("up").alias("next_up"))
        jump = settled(jump.join(step, F.col("up") == F.col("mid")).select("node", F.col("next_up").alias("up")), "jump")
        reach *= 2
    return known.select("node", "subtree", "depth", *[F.col(o).alias(c) for c, o in zip(sums, own, strict=True)])


def roots(tree: DataFrame, child: str, parent: str) -> DataFrame:
    """node, root of every node of a forest, however deep; a cycle is an error."""
    nodes = tree.select(F.col(child).alias("node"), F.coalesce(F.col(parent), F.col(child)).alias("root")).union(tree.where(F.col(parent).isNotNull()).select(parent, parent))
    inner = tree.where(F.col(parent).isNotNull()).select(F.col(child).alias("inner_node"))
    tops = nodes.select(F.col("root").alias("node")).distinct().join(inner, F.col("node") == F.col("inner_node"), "left_anti").select("node", F.col("node").alias("root"))
    links = tree.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("root"))
    reach = settled(links.union(tops), "roots")
    n, steps = reach.count(), 1
    while True:
        up = reach.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        moved = settled(reach.join(up, F.col("root") == F.col("mid")).select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        reach = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return reach
        if (steps := steps * 2) > 2 * n:
            raise ValueError("the tree has a cycle")


def without_unit_cycles(units: DataFrame, unit: str, above: str) -> DataFrame:
    """unit, above with one link of each cycle cut, so that no unit is unreachable: the walk upwards from the smallest
    unit that leads into a cycle enters it at the unit whose link is cut. Links to themselves or to unknown units go."""
    known = units.select(F.col(unit).alias("known_unit"))
    sound = units.join(known, F.col(above) == F.col("known_unit"), "left").select(unit, F.when(F.col("known_unit") != F.col(unit), F.col("known_unit")).alias(above))
    sound = settled(sound, "units")
    ring = settled(cycles(sound.where(F.col(above).isNotNull()).select(F.col(unit).alias("node"), F.col(above).alias("parent"))), "ring")
    if ring.isEmpty():
        return sound
    opened = sound.join(ring, F.col(unit) == F.col("node"), "left").select(unit, F.when(F.col("node").isNull(), F.col(above)).alias(above))
    entry = roots(opened, unit, above)
    first = entry.join(ring.select(F.col("node").alias("root"), "cycle"), "root").groupBy("cycle").agg(F.min_by("root", F.col("node")).alias("cut_unit"))
    out = sound.join(first.select("cut_unit"), F.col(unit) == F.col("cut_unit"), "left")
    return out.select(unit, F.when(F.col("cut_unit").isNull(), F.col(above)).alias(above))


def unit_members(units: DataFrame, unit: str, above: str, members: DataFrame, member: str) -> DataFrame:
    """unit, members: distinct members of each unit and all units below it, however deep."""
    up = ancestors(units, unit, above).select(F.col("node").alias("low_unit"), F.col("ancestor").alias("high_unit"))
    own = members.select(F.col(unit).alias("low_unit"), member)
    rolled = own.join(up, "low_unit").select(F.col("high_unit").alias(unit), member).union(own)
    every = units.select(unit).union(units.where(F.col(above).isNotNull()).select(above)).distinct()
    return every.join(rolled, unit, "left").groupBy(unit).agg(F.countDistinct(member).alias("members"))


def branch_chart(tree: DataFrame, child: str, parent: str, name: str, unresolved: str, detail: int = 60) -> DataFrame:
    """node, name, kind (branch or person), person_count, unresolved_count, position: the top level of a chart.

    A forest of at most `detail` people shows everyone; a larger one shows its roots, those with people below them as
    collapsed branches. Branches come before people, both by name without case, then by node: position, from 0.
    """
    sizes = subtree_sizes(tree, child, parent, (unresolved,))
    rows = tree.select(F.col(child).alias("of"), F.col(name).alias("name"), F.col(parent).alias("above")).join(sizes, F.col("of") == F.col("node"))
    whole = tree.count() <= detail
    shown = rows if whole else rows.where("above is null")
    kind = F.lit("person") if whole else F.when(F.col("subtree") > 1, "branch").otherwise("person")
    counted = F.col("kind") == "branch"
    nodes = shown.withColumn("kind", kind).select("node", "name", "kind", F.when(counted, F.col("subtree")).alias("person_count"), F.when(counted, F.col(unresolved)).alias("unresolved_count"))
    place = F.row_number().over(Window.orderBy(F.col("kind") == "person", F.lower("name"), "node")) - 1  # what a chart shows
    return nodes.withColumn("position", place)


def bounded_view(tree: DataFrame, child: str, parent: str, name: str, focus: object, limit: int = 80, most_ancestors: int = 40) -> DataFrame:
    """node, position of at most `limit` nodes around a focus: the focus, its nearest ancestors, then children level by
    level, in the order of their parents and by name without case. Each level takes what the limit still allows."""
    link = tree.select(F.col(child).alias("node"), F.col(parent).alias("above"), F.lower(name).alias("sort_name"))
    spark = tree.sparkSession
    kind = link.schema["node"].dataType.simpleString()
    walk = ancestors(tree, child, parent, most_ancestors).where(F.col("node") == F.lit(focus)).orderBy("steps").select("ancestor").collect()
    chosen = list(dict.fromkeys([focus, *[r["ancestor"] for r in walk]]))[: min(most_ancestors, limit)]
    placed = [(n, i) for i, n in enumerate(chosen)]
    level = list(placed)
    while level and len(placed) < limit:
        parents = spark.createDataFrame(level, f"parent_node {kind}, parent_position int")
        seen = spark.createDataFrame([(n,) for n, _ in placed], f"seen_node {kind}")
        below = link.join(F.broadcast(parents), F.col("above") == F.col("parent_node")).join(F.broadcast(seen), F.col("node") == F.col("seen_node"), "left_anti")
        found = [r["node"] for r in below.orderBy("parent_position", "sort_name", "node").limit(limit - len(placed)).select("node").collect()]
        level = [(n, len(placed) + i) for i, n in enumerate(found)]
        placed += level
    return spark.createDataFrame(placed, f"node {kind}, position int")


def expanded(edges: DataFrame, edge: str, a: str, b: str, seeds: DataFrame, hops: int = 2, per_node: int = 50, most_edges: int = 500) -> tuple[DataFrame, set[str]]:
    """edge, hop (0: a seed) of a bounded undirected expansion from seed edges (columns edge, score), and why it stopped
    short: edge_budget, per_node_budget, visit_budget.

    The best seeds come first, by score and edge. Each hop visits the nodes of the edges that the hop before added, in
    order, and of each its first `per_node` edges; visits and edges are at most `most_edges` in all, so every frame
    beyond the join with the edges is of bounded size.
    """
    ends = edges.select(F.col(edge).alias("e"), F.explode(F.array_distinct(F.array(a, b))).alias("node"))
    best = seeds.select(F.col(edge).alias("e"), "score").orderBy(F.desc("score"), "e")
    reasons = {"edge_budget"} if best.limit(most_edges + 1).count() > most_edges else set()
    selected = settled(best.limit(most_edges).select("e", F.lit(0).alias("hop")), "expansion")
    new, visited, visits = selected, None, 0
    for hop in range(1, hops + 1):
        frontier = ends.join(F.broadcast(new.select(F.col("e").alias("e0"))), F.col("e") == F.col("e0")).select("node").distinct()
        frontier = frontier if visited is None else frontier.join(visited, "node", "left_anti")
        frontier = settled(frontier, "expansion")
        visited = frontier if visited is None else visited.union(frontier)
        near = ends.join(F.broadcast(frontier.withColumnRenamed("node", "n0")), F.col("node") == F.col("n0")).select("node", "e")
        ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("e"))).where(F.col("place") <= per_node + 1)
        ranked = settled(ranked, "expansion")
        if not ranked.where(F.col("place") > per_node).isEmpty():
            reasons.add("per_node_budget")
        step = ranked.where(F.col("place") <= per_node).orderBy("node", "e").limit(most_edges - visits + 1)
        step = settled(step.withColumn("visit", F.row_number().over(Window.orderBy("node", "e"))), "expansion")  # bounded by the visits left
        if step.count() > most_edges - visits:
            reasons.add("visit_budget")
        step = step.where(F.col("visit") <= most_edges - visits)
        visits += step.count()
        fresh = step.groupBy("e").agg(F.min("visit").alias("visit")).join(selected.select(F.col("e").alias("e0")), F.col("e") == F.col("e0"), "left_anti")
        new = settled(fresh.orderBy("visit").limit(max(0, most_edges - selected.count())).select("e", F.lit(hop).alias("hop")), "expansion")
        selected = settled(selected.union(new), "expansion")
        if new.isEmpty():
            break
    return selected.select(F.col("e").alias(edge), "hop"), reasons


def overview(assertions: DataFrame, item: str, a: str, b: str, document: str, modality: str, disputed: str) -> DataFrame:
    """One row: assertions, documents, entities, reported, planned, negated, disputed."""
    entities = endpoints(assertions, item, a, b).select("node").distinct().agg(F.count(F.lit(1)).alias("entities"))
    modal = [F.count(F.when(F.col(modality) == m, 1)).alias(m) for m in ("reported", "planned", "negated")]
    counts = assertions.agg(F.count(F.lit(1)).alias("assertions"), F.countDistinct(document).alias("documents"), *modal, F.count(F.when(F.col(disputed), 1)).alias("disputed"))
    return counts.join(F.broadcast(entities))  # one row each


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of an undirected graph: each round every node takes the smallest label of
    its neighbours and then that label's own label, so labels travel twice as far each time."""
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = settled(both.union(both.select("b", "a")).where("a is not null and b is not null").distinct(), "both")
    labels = settled(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("n"), "component"), F.col("b") == F.col("n")).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        own = step.select(F.col("node").alias("m"), F.col("component").alias("jump"))
        new = settled(step.join(own, F.col("component") == F.col("m"), "left").select("node", F.least("component", F.coalesce("jump", "component")).alias("component"), "was"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def first_sample(edges: DataFrame, a: str, b: str, relation: str, order: str, most_nodes: int = 24, most_edges: int = 40) -> DataFrame:
    """source, target, relation, place (from 1) of a bounded sample of a graph, first come, first served: of the different
    edges by their smallest value of the column order, which no two of them may share, each is taken unless its new ends are more than the nodes that are left.

    Each round asks for the next edges that still fit, a few, and takes them one by one; a round without any ends the
    sample. Loops and edges without an end don't count.
    """
    spark = edges.sparkSession
    rows = edges.where(F.col(a) != F.col(b))
    firsts = settled(rows.groupBy(F.col(a).alias("source"), F.col(b).alias("target"), F.col(relation).alias("relation")).agg(F.min(order).alias("at")), "firsts")
    chosen: dict[object, None] = {}
    taken: list[tuple] = []
    last = None
    while len(taken) < most_edges:
        free = most_nodes - len(chosen)
        known = list(chosen)
        new = sum((F.when(F.col(c).isin(known), 0).otherwise(1) for c in ("source", "target")), F.lit(0)) if known else F.lit(2)
        fit = firsts.where(new <= free)
        if last is not None:
            fit = fit.where(F.col("at") > F.lit(last))
        few = fit.orderBy("at", "source", "target", "relation").limit(most_edges).collect()  # a few rows
        for r in few:
            last = r["at"]
            missing = {r["source"], r["target"]} - chosen.keys()
            if len(taken) < most_edges and len(chosen) + len(missing) <= most_nodes:
                chosen |= dict.fromkeys((r["source"], r["target"]))
                taken.append((r["source"], r["target"], r["relation"], len(taken) + 1))
        if not few:
            break
    kinds = {f.name: f.dataType.simpleString() for f in firsts.schema}
    return spark.createDataFrame(taken, f"source {kinds['source']}, target {kinds['target']}, relation {kinds['relation']}, place int")


def entity_list(tree: DataFrame, child: str, parent: str, status: str, people: DataFrame, person: str, name: str) -> DataFrame:
    """person, name, manager, manager_name, status of everyone in people whom the tree places; the manager's name is null
    for those without one, or where nobody has that id."""
    own = people.select(F.col(person).alias("person"), F.col(name).alias("name"))
    above = people.select(F.col(person).alias("above_id"), F.col(name).alias("manager_name"))
    rows = tree.join(own, F.col(child) == F.col("person")).join(above, F.col(parent) == F.col("above_id"), "left")
    return rows.select("person", "name", F.col(parent).alias("manager"), "manager_name", F.col(status).alias("status"))
