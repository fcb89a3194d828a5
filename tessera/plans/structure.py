"""Registered queries on communities, validity, folds over ordered rows, samples, validation, nested documents, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import communities as N
from tessera.operators import evidence as E
from tessera.operators import graph as R
from tessera.operators import nested as J
from tessera.operators import quality as Q
from tessera.operators import validity as V
from tessera.plans.knowledge import FOREST, forest_cut
from tessera.plans.requests import ORACLES, QUERIES, query, table
from tessera.session import shared_folder
from tessera.streaming import ingest as S


@query("""
WITH h AS (SELECT c_nationkey AS nation, min(c_custkey) AS hub, count(*) AS members FROM customer GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT hub, members, c_custkey AS c FROM customer JOIN h ON c_nationkey = nation WHERE c_custkey <> hub)
SELECT hub AS community, members, round((sum(CASE WHEN (c * 7 + 5) % 10 < 8 THEN 1 ELSE 0 END) + sum(CASE WHEN (c * 7 + 10) % 10 < 8 THEN 1 ELSE 0 END) + sum(CASE WHEN (c * 7 + 15) % 10 < 8 THEN 1 ELSE 0 END) + 3) / (3.0 * members), 4) AS mean_best_jaccard FROM e GROUP BY hub, members
""")
def community_stability(spark, folder):
    """Customers who write to the first of their nation: each nation is a community; a fifth of the links is lost in each
    of three samples."""
    customer = table(spark, folder, "customer")
    hubs = customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").alias("hub"))
    edges = customer.join(hubs, F.col("c_nationkey") == F.col("nation")).where("c_custkey <> hub").select("hub", "c_custkey", (1 + F.col("c_custkey") % 5).alias("weight"))
    kept = [F.lit(True), *[(F.col("c_custkey") * 7 + 5 * i) % 10 < 8 for i in (1, 2, 3)]]
    return N.stable_communities(edges, "hub", "c_custkey", "weight", kept)[1]


# Parents over time: candidates of a customer by arithmetic, each with its days; some neighbours name each other.


def dated_candidates(spark, folder) -> DataFrame:
    customer = table(spark, folder, "customer").withColumn("n", F.lit(table(spark, folder, "customer").agg(F.max("c_custkey").alias("n")).first()["n"]))
    c, first = F.col("c_custkey"), F.lit("2024-01-01").cast("date")

    def part(parent: str, priority: int, score: Column, of: str, start: Column, end: Column) -> DataFrame:
        return customer.where(of).select(c.alias("child"), F.expr(parent).alias("parent"), F.lit(priority).alias("priority"), score.alias("score"), start.alias("start"), end.alias("end"))

    none = F.lit(None).cast("date")
    later = F.date_add(first, (c % 4 * 30).cast("int"))
    parts = [
        part("c_custkey * 7 % n + 1", 2, (c % 10 / 10.0).cast("double"), "true", none, F.date_add(first, (60 + c % 3 * 30).cast("int"))),
        part("c_custkey * 11 % n + 1", 2, (c % 7 / 8.0).cast("double"), "c_custkey % 2 = 0", later, none),
        part("cast(floor(c_custkey / 3) as bigint) + 1", 1, F.lit(0.0), "c_custkey % 3 = 0", later, F.date_add(later, 60)),
        part("c_custkey % n + 1", 1, F.lit(0.0), "c_custkey % 6 = 0", F.date_add(first, 30), F.date_add(first, 60)),
        part("c_custkey + 1", 0, F.lit(0.0), "c_custkey % 20 = 4", F.date_add(first, 14), F.date_add(first, 74)),
        part("c_custkey - 1", 0, F.lit(0.0), "c_custkey % 20 = 5", F.date_add(first, 30), none),
    ]
    return reduce(DataFrame.union, parts)


DATED = """n AS (SELECT max(c_custkey) AS n FROM customer), c0 AS (SELECT c_custkey AS c, DATE '2024-01-01' + CAST(c_custkey % 4 * 30 AS INTEGER) AS later FROM customer),
k0(child, parent, priority, score, lo, hi) AS (SELECT c, c * 7 % n + 1, 2, c % 10 / 10.0::DOUBLE, DATE '0001-01-01', DATE '2024-01-01' + CAST(60 + c % 3 * 30 AS INTEGER) FROM c0, n UNION ALL SELECT c, c * 11 % n + 1, 2, c % 7 / 8.0::DOUBLE, later, DATE '9999-12-31' FROM c0, n WHERE c % 2 = 0
 UNION ALL SELECT c, CAST(floor(c / 3) AS BIGINT) + 1, 1, 0.0, later, later + 60 FROM c0 WHERE c % 3 = 0 UNION ALL SELECT c, c % n + 1, 1, 0.0, DATE '2024-01-31', DATE '2024-03-01' FROM c0, n WHERE c % 6 = 0
 UNION ALL SELECT c, c + 1, 0, 0.0, DATE '2024-01-15', DATE '2024-03-15' FROM c0 WHERE c % 20 = 4 UNION ALL SELECT c, c - 1, 0, 0.0, DATE '2024-01-31', DATE '9999-12-31' FROM c0 WHERE c % 20 = 5),
k AS (SELECT * FROM k0 WHERE child <> parent), d AS (SELECT DISTINCT lo AS d FROM k UNION SELECT hi FROM k), g AS (SELECT d AS a, lead(d) OVER (ORDER BY d) AS z FROM d QUALIFY z IS NOT NULL),
r AS (SELECT a, z, child, parent, priority, max(score) AS score FROM k JOIN g ON lo <= a AND z <= hi GROUP BY ALL), t AS (SELECT *, min(priority) OVER (PARTITION BY a, child) AS fp FROM r),
u AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM t WHERE priority = fp WINDOW w AS (PARTITION BY a, child ORDER BY score DESC, parent)),
p AS MATERIALIZED (SELECT a, z, child, parent FROM u WHERE place = 1 AND CASE WHEN priority <= 1 THEN nxt IS NULL ELSE score >= 0.55 AND (nxt IS NULL OR score - nxt >= 0.08) END)"""


@query(f"WITH {DATED} SELECT child, parent, CAST(sum(z - a) AS BIGINT) AS days FROM p GROUP BY ALL")
def dated_parents(spark, folder):
    """For how many days each parent is the one in force."""
    held = V.parents_in_force(dated_candidates(spark, folder), "child", "parent", "priority", "score", "start", "end")
    return held.groupBy("child", "parent").agg(F.sum(V.days()).alias("days"))


@query(f"""
WITH RECURSIVE {DATED}, w(a, node, step) AS (SELECT a, child, 0 FROM p UNION ALL SELECT DISTINCT p.a, p.parent, step + 1 FROM w JOIN p ON p.a = w.a AND p.child = w.node WHERE step <= (SELECT n FROM n))
SELECT node, CAST(sum(z - a) AS BIGINT) AS days FROM w JOIN g USING (a) WHERE step = (SELECT n FROM n) AND EXISTS (SELECT 1 FROM p WHERE p.a = w.a AND p.child = w.node) GROUP BY 1
""")
def dated_cycles(spark, folder):
    """For how many days a customer is on a cycle of parents in force."""
    held = V.parents_in_force(dated_candidates(spark, folder), "child", "parent", "priority", "score", "start", "end")
    return V.cycles_over_time(held).groupBy("node").agg(F.sum(V.days()).alias("days"))


# Folds over the rows of a key.


@query("""
WITH RECURSIVE o AS MATERIALIZED (SELECT o_custkey, o_orderkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
w AS (SELECT o_custkey, o_orderkey, r, CASE WHEN s <= 500000 THEN s ELSE 0 END AS used, s <= 500000 AS taken FROM o WHERE r = 1
 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.r, CASE WHEN w.used + s <= 500000 THEN w.used + s ELSE w.used END, w.used + s <= 500000 FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.r = w.r + 1)
SELECT o_custkey, o_orderkey, round(used, 2) AS used FROM w WHERE taken
""")
def skip_budget(spark, folder):
    """A customer's orders by day, each taken if it still fits into 500,000; later smaller ones may."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    taken = A.greedy_budget(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000, [])
    return taken.select("o_custkey", "o_orderkey", F.round("used", 2).alias("used"))


@query("""
WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, value AS pos, CAST(1 + event_id % 7 AS DOUBLE) AS e, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, event_id, r, 1 AS line, [pos] AS ps, [e] AS es FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.event_id, o.r, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN list_append(ps, w.pos) ELSE [w.pos] END, CASE WHEN j THEN list_append(es, w.e) ELSE [w.e] END
 FROM (SELECT w.*, o.event_id AS ne, o.pos, o.e, abs(o.pos - list_median(w.ps)) <= greatest(0.5, least(o.e, list_median(w.es)) * 0.4) AS j FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1) w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
SELECT user_id, event_id, CAST(line AS INTEGER) AS line FROM w
""")
def tolerance_lines(spark, folder):
    """A user's events by value, in one line as long as they lie near the median of the line so far."""
    events = table(spark, folder, "events").select("user_id", "event_id", "value", (1 + F.col("event_id") % 7).cast("double").alias("extent"))
    return A.tolerance_groups(events, ["user_id"], "value", "extent", "event_id", least=0.5).select("user_id", "event_id", "line")


# Samples, lists and validation.


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY pos) AS r FROM (SELECT 'n' || c_nationkey AS s, 'p' || o_orderpriority AS t, o_orderstatus AS k, min(o_orderkey) AS pos FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)),
x AS (SELECT e.*, CAST([] AS VARCHAR[]) AS seen, 0 AS took, false AS y FROM e WHERE false UNION ALL SELECT NULL, NULL, NULL, NULL, 0, CAST([] AS VARCHAR[]), 0, false),
w(r, s, t, k, seen, took, y) AS (SELECT r, s, t, k, seen, took, y FROM x UNION ALL
 SELECT q.r, q.s, q.t, q.k, CASE WHEN q.fit THEN q.more ELSE q.seen END, q.took + CASE WHEN q.fit THEN 1 ELSE 0 END, q.fit
 FROM (SELECT e.r, e.s, e.t, e.k, w.seen, w.took, list_distinct(list_concat(w.seen, [e.s, e.t])) AS more, w.took < 40 AND len(list_distinct(list_concat(w.seen, [e.s, e.t]))) <= 24 AS fit FROM w JOIN e ON e.r = w.r + 1) q)
SELECT s AS source, t AS target, k AS relation, CAST(took AS INTEGER) AS place FROM w WHERE y
""")
def source_sample(spark, folder):
    """Nations and priorities that orders link, first come, first served: 24 of them and 40 links."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    edges = orders.select(F.concat(F.lit("n"), "c_nationkey").alias("s"), F.concat(F.lit("p"), "o_orderpriority").alias("t"), F.col("o_orderstatus").alias("k"), "o_orderkey")
    return R.first_sample(edges, "s", "t", "k", "o_orderkey")


@query(f"""
{FOREST} SELECT c.c_custkey AS person, c.c_name AS name, f.parent AS manager, m.c_name AS manager_name, f.status FROM f JOIN customer c ON c.c_custkey = f.child LEFT JOIN customer m ON m.c_custkey = f.parent
""")
def entity_list(spark, folder):
    return R.entity_list(forest_cut(spark, folder), "child", "parent", "status", table(spark, folder, "customer"), "c_custkey", "c_name")


@query("""
WITH RECURSIVE n AS (SELECT max(c_custkey) AS n FROM customer),
k(child, parent, priority, score, barred) AS (SELECT c_custkey, c_custkey * 7 % n + 1, 2, c_custkey % 10 / 10.0::DOUBLE, CASE WHEN c_custkey % 13 = 0 THEN 'outside_time_scope' WHEN c_custkey % 23 = 0 THEN 'unknown_dates' END FROM customer, n
 UNION ALL SELECT c_custkey, c_custkey * 11 % n + 1, 2, c_custkey % 7 / 8.0::DOUBLE, CASE WHEN c_custkey % 26 = 0 THEN 'evidence_unavailable' END FROM customer, n WHERE c_custkey % 2 = 0
 UNION ALL SELECT c_custkey, CAST(floor(c_custkey / 3) AS BIGINT) + 1, 1, 0.0, NULL FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_custkey % n + 1, 1, 0.0, NULL FROM customer, n WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 5, 0, 0.0, NULL FROM customer WHERE c_custkey % 36 = 0),
r AS (SELECT * FROM k WHERE child <> parent AND parent IN (SELECT c_custkey FROM customer) AND child IN (SELECT c_custkey FROM customer)), g AS (SELECT child, priority, parent, max(score) AS score FROM r WHERE barred IS NULL GROUP BY ALL),
t AS (SELECT * FROM g QUALIFY priority = min(priority) OVER (PARTITION BY child)), u AS (SELECT *, row_number() OVER x AS place, lead(score) OVER x AS nxt FROM t WINDOW x AS (PARTITION BY child ORDER BY score DESC, parent)),
j AS MATERIALIZED (SELECT *, CASE WHEN priority = 1 AND nxt IS NOT NULL THEN 'conflicting_sources' WHEN priority > 1 AND score < 0.55 THEN 'weak_evidence' WHEN priority > 1 AND score - nxt < 0.08 THEN 'close_alternatives' END AS doubt FROM u WHERE place = 1 AND child % 17 <> 0),
c AS MATERIALIZED (SELECT child, parent, priority, score FROM j WHERE doubt IS NULL), """ + "w(start" + FOREST.split("w(start", 1)[1] + """
SELECT c_custkey AS person, f.parent, CASE WHEN c_custkey % 17 = 0 THEN 'analyst_rejected' ELSE coalesce(f.status, j.doubt, (SELECT max(barred) FROM r WHERE r.child = c_custkey), 'insufficient_evidence') END AS status FROM customer LEFT JOIN f ON f.child = c_custkey LEFT JOIN j ON j.child = c_custkey
""")
def projected_forest(spark, folder):
    """A parent of each customer by decisions, sources and scores, or why it has none."""
    customer = table(spark, folder, "customer")
    both = customer.withColumn("n", F.lit(customer.agg(F.max("c_custkey").alias("n")).first()["n"]))
    parts = [
        ("c_custkey * 7 % n + 1", 2, "cast(c_custkey % 10 / 10.0 as double)", "case when c_custkey % 13 = 0 then 'outside_time_scope' when c_custkey % 23 = 0 then 'unknown_dates' end", "true"),
        ("c_custkey * 11 % n + 1", 2, "cast(c_custkey % 7 / 8.0 as double)", "case when c_custkey % 26 = 0 then 'evidence_unavailable' end", "c_custkey % 2 = 0"),
        ("cast(floor(c_custkey / 3) as bigint) + 1", 1, "0.0d", "cast(null as string)", "c_custkey % 3 = 0"), ("c_custkey % n + 1", 1, "0.0d", "cast(null as string)", "c_custkey % 6 = 0"), ("5L", 0, "0.0d", "cast(null as string)", "c_custkey % 36 = 0"),
    ]
    frames = [both.where(of).selectExpr("c_custkey as child", f"{parent} as parent", f"{priority} as priority", f"{score} as score", f"{barred} as barred") for parent, priority, score, barred, of in parts]
    rejected = customer.where("c_custkey % 17 = 0").selectExpr("c_custkey as child")
    return R.projected(customer, "c_custkey", reduce(DataFrame.union, frames), rejected)


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w, lower(text) AS t, doc_id % 5 AS e FROM documents)
SELECT doc_id, coalesce(list_contains(w, 'license') AND list_contains(w, 'work'), false) AS tokens, coalesce(contains(t, 'lic') AND e IN (1, 3), false) AS scoped FROM w
""")
def token_search(spark, folder):
    """Documents that hold whole words, and documents about some of five entities that hold a part of one."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.array(F.col("doc_id") % 5, F.lit(-1)).alias("about"))
    scoped = E.searched(docs, "text", ["LIC"], "about", [1, 3]).select(F.col("doc_id").alias("found_id"))
    rows = docs.join(scoped, F.col("doc_id") == F.col("found_id"), "left")
    return rows.select("doc_id", E.all_tokens(F.col("text"), ["License work"]).alias("tokens"), F.col("found_id").isNotNull().alias("scoped"))


@query("""
WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS e, min('o' || l_orderkey) AS a, min('p' || l_partkey) AS b FROM lineitem GROUP BY 1), f AS (SELECT 'p' || min(l_partkey) AS f FROM lineitem), s0 AS (SELECT e FROM e, f WHERE b = f ORDER BY e LIMIT 200),
n1 AS (SELECT DISTINCT a AS n FROM e WHERE e IN (SELECT e FROM s0) UNION SELECT b FROM e WHERE e IN (SELECT e FROM s0)), s1 AS (SELECT e FROM e WHERE (a IN (SELECT n FROM n1) OR b IN (SELECT n FROM n1)) AND e NOT IN (SELECT e FROM s0))
SELECT e AS edge, 0 AS hop FROM s0 UNION ALL SELECT e, 1 FROM s1
""")
def part_neighbourhood(spark, folder):
    """The line items of the first part, and those of their orders."""
    items = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge")).agg(F.min(F.concat(F.lit("o"), "l_orderkey")).alias("a"), F.min(F.concat(F.lit("p"), "l_partkey")).alias("b"))
    first = table(spark, folder, "lineitem").agg(F.min("l_partkey").alias("p")).first()["p"]
    return R.neighbourhood(items, "edge", "a", "b", f"p{first}", hops=2, per_node=200, most_edges=5000)[0]


@query("""
WITH p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CAST((c_custkey + 1) % n AS VARCHAR) WHEN 1 THEN upper(c_mktsegment) || ' ' || c_custkey // 3 WHEN 2 THEN 'nobody' WHEN 3 THEN ' ' WHEN 4 THEN CAST(c_custkey AS VARCHAR) END AS m, n FROM customer, (SELECT count(*) AS n FROM customer)),
k AS (SELECT CAST(c_custkey AS VARCHAR) AS k, 0 AS r, c_custkey AS e FROM customer UNION ALL SELECT lower(c_mktsegment) || ' ' || c_custkey // 3, 1, c_custkey FROM customer), g AS (SELECT k, r, min(e) AS e, count(DISTINCT e) AS n FROM k GROUP BY ALL), b AS (SELECT k, arg_min(e, r) AS e, arg_min(n, r) AS n FROM g GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(trim(m), '') = '' THEN 'none' WHEN b.n = 1 AND b.e = c_custkey THEN 'self' WHEN b.k IS NULL THEN 'unknown' WHEN b.n > 1 THEN 'ambiguous' ELSE 'matched' END AS manager_outcome, CASE WHEN coalesce(trim(m), '') <> '' AND b.n = 1 AND b.e <> c_custkey THEN b.e END AS manager_id FROM p LEFT JOIN b ON b.k = lower(trim(m))
""")
def roster_managers(spark, folder):
    """Customers who state a manager by id, by a name that others may share, by nobody's name, not at all, or themselves."""
    customer = table(spark, folder, "customer")
    c, n = F.col("c_custkey"), customer.count()
    stated = F.when(c % 6 == 0, ((c + 1) % n).cast("string")).when(c % 6 == 1, F.concat(F.upper("c_mktsegment"), F.lit("  "), F.expr("c_custkey div 3"))).when(c % 6 == 2, "nobody").when(c % 6 == 3, " ").when(c % 6 == 4, c.cast("string"))
    people = customer.select("c_custkey", F.array(F.expr("concat(c_mktsegment, ' ', c_custkey div 3)")).alias("names"), F.col("c_mktsegment").alias("unit"), stated.alias("manager"))
    return E.roster_links(people, "c_custkey", "names", "unit", "manager")[0].select("c_custkey", "manager_outcome", "manager_id")


@query("""
WITH p AS (SELECT CASE WHEN c_custkey % 40 = 3 THEN c_custkey - 1 WHEN c_custkey % 60 = 5 THEN c_custkey - 1 ELSE c_custkey END AS id, CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 60 = 4 THEN 'same' WHEN c_custkey % 60 = 5 THEN 'same' ELSE c_name END AS name,
 CASE WHEN c_custkey % 60 IN (4, 5) THEN '1' WHEN c_custkey % 11 = 0 THEN 'x1' ELSE CAST(c_acctbal AS VARCHAR) END AS balance, CASE WHEN c_custkey % 60 IN (4, 5) THEN '2024-01-01' WHEN c_custkey % 13 = 0 THEN '2024-13-01' ELSE '2024-01-01' END AS since,
 CASE WHEN c_custkey % 60 IN (4, 5) THEN 'person' WHEN c_custkey % 17 = 0 THEN 'robot' ELSE 'person' END AS type, CASE WHEN c_custkey % 60 IN (4, 5) THEN 1 WHEN c_custkey % 19 = 0 THEN 99 ELSE c_nationkey END AS nation FROM customer),
q AS (SELECT id, count(*) AS n, count(DISTINCT (name, balance, since, type, nation)) AS kinds FROM p GROUP BY 1)
SELECT 'people' AS "table", CAST(id AS VARCHAR) AS id, field, code FROM (
 SELECT id, 'name' AS field, 'missing' AS code FROM p WHERE trim(name) = '' UNION ALL SELECT id, 'balance', 'not_a_number' FROM p WHERE balance LIKE 'x%' UNION ALL SELECT id, 'since', 'not_a_date' FROM p WHERE since LIKE '%-13-%'
 UNION ALL SELECT id, 'type', 'unknown_value' FROM p WHERE type = 'robot' UNION ALL SELECT id, 'nation', 'unknown_nations' FROM p WHERE nation = 99 UNION ALL SELECT id, 'id', CASE WHEN kinds > 1 THEN 'conflicting_id' ELSE 'duplicate_id' END FROM q WHERE n > 1)
""")
def dataset_faults(spark, folder):
    """Customers with faults that follow from their keys, and the nations they name."""
    c = F.col("c_custkey")
    twin = (c % 60).isin(4, 5)
    people = table(spark, folder, "customer").select(
        F.when((c % 40 == 3) | (c % 60 == 5), c - 1).otherwise(c).alias("id"), F.when(c % 9 == 0, " ").when(twin, "same").otherwise(F.col("c_name")).alias("name"),
        F.when(twin, "1").when(c % 11 == 0, "x1").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(twin, "2024-01-01").when(c % 13 == 0, "2024-13-01").otherwise("2024-01-01").alias("since"),
        F.when(twin, "person").when(c % 17 == 0, "robot").otherwise("person").alias("type"), F.when(twin, 1).when(c % 19 == 0, 99).otherwise(F.col("c_nationkey")).alias("nation"),
    )
    rules = [
        Q.Rule("people", "unique", "id"), Q.Rule("people", "required", "name"), Q.Rule("people", "number", "balance"), Q.Rule("people", "date", "since"),
        Q.Rule("people", "one_of", "type", ("person", "unit", "shared_mailbox")), Q.Rule("people", "reference", "nation", to=("nations", "n_nationkey")),
    ]
    return Q.dataset_faults({"people": people, "nations": table(spark, folder, "nation")}, {"people": "id", "nations": "n_nationkey"}, rules)


@query("""
WITH s(k, property, number, outcome, value, preferred) AS (VALUES (0, 'P1', 0, 'admitted', 'size', true), (0, 'P1', 1, 'admitted', 'x', false), (0, 'P2', 0, 'deprecated_rank', 'brand', false), (1, 'P1', 0, 'no_value', NULL, false), (1, 'P3', 0, 'unknown_value', NULL, false), (1, 'P3', 1, 'admitted', 'type', false),
 (2, 'P1', 0, 'has_ended', 'size', false), (2, 'P1', 1, 'admitted', 'size', false), (2, 'P2', 0, 'without_datavalue', NULL, false), (2, 'P9', 0, 'admitted', 'brand', false))
SELECT p_partkey, property, CAST(number AS INTEGER) AS number, outcome, CASE value WHEN 'size' THEN CAST(p_size AS VARCHAR) WHEN 'brand' THEN p_brand WHEN 'type' THEN p_type ELSE value END AS value,
 outcome = 'admitted' AND property <> 'P9' AND (preferred OR (k, property) NOT IN ((0, 'P1'))) AS evidence FROM part JOIN s ON s.k = p_partkey % 5
""")
def nested_statements(spark, folder):
    """Parts as nested documents of statements; some can't be parsed, some have none."""
    forms = [
        '{"claims": {"P1": [{"rank": "preferred", "mainsnak": {"snaktype": "value", "datavalue": {"type": "quantity", "value": {s}}}}, {"mainsnak": {"snaktype": "value", "datavalue": {"type": "string", "value": "x"}}}], "P2": [{"rank": "deprecated", "mainsnak": {"snaktype": "value", "datavalue": {"value": "{b}"}}}]}}',
        '{"claims": {"P1": [{"mainsnak": {"snaktype": "novalue"}}], "P3": [{"mainsnak": {"snaktype": "somevalue"}}, {"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": "{t}"}}}]}, "id": 3}',
        '{"claims": {"P1": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": {s}}}, "qualifiers": {"end": "2020"}}, {"mainsnak": {"snaktype": "value", "datavalue": {"value": {s}}}}], "P2": [{"mainsnak": {"snaktype": "value"}}], "P9": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": "{b}"}}}]}}',
        '{"claims": [}', '{"labels": {}}',
    ]
    document = F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 5).cast("int"))
    for mark, column in (("{s}", "p_size"), ("{b}", "p_brand"), ("{t}", "p_type")):
        document = F.replace(document, F.lit(mark), F.col(column).cast("string"))
    found = J.statements_of(table(spark, folder, "part").withColumn("document", document), "p_partkey", F.col("document"))
    kept = J.evidence_of(found, "p_partkey", {"P1": "size", "P2": "brand", "P3": "kind"}).select(F.col("p_partkey").alias("k"), F.col("predicate"), F.col("value").alias("v"), "preferred").distinct()
    named = F.element_at(F.create_map(*map(F.lit, ("P1", "size", "P2", "brand", "P3", "kind", "P9", "other"))), F.col("property"))
    same = (F.col("p_partkey") == F.col("k")) & (named == F.col("predicate")) & F.col("value").eqNullSafe(F.col("v")) & (F.col("preferred") == (F.col("rank") == "preferred")) & (F.col("outcome") == J.ADMITTED)
    return found.join(kept, same, "left").select("p_partkey", "property", "number", "outcome", "value", F.col("k").isNotNull().alias("evidence"))


# Windows and timers over the events as a stream: extensions, without a like among the batch operators.


def event_stream(spark, folder) -> DataFrame:
    return S.file_stream(spark, f"{folder}/events.parque[t]", table(spark, folder, "events").schema, kind="parquet")


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session
""")
def stream_sessions(spark, folder):
    counts = S.final_state(S.session_counts(event_stream(spark, folder), "ts", ["user_id"], "12 hours", late="60 days"))
    return counts.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""
SELECT event_type, strftime(day - CAST(k AS INTEGER), '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT event_type, CAST(ts AS DATE) AS day FROM events), range(3) r(k) GROUP BY ALL
""")
def stream_sliding_counts(spark, folder):
    """Windows of three days that begin every day."""
    counts = S.final_state(S.sliding_counts(event_stream(spark, folder), "ts", ["event_type"], "3 days", "1 day", late="60 days"))
    return counts.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_silences(spark, folder):
    """Users who have been silent for 24 hours when the events end. A user who comes back between two batches is not; all
    events are one batch here."""
    place = S.new_place(shared_folder(spark))
    found = S.appended(S.silences(event_stream(spark, folder), "user_id", "ts", 24), place)
    return found.select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "n")


__all__ = ["ORACLES", "QUERIES"]
