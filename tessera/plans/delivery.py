"""Registered queries on staging, change ledgers, charts, bounded expansion, pages, releases and gates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import aggregates as A
from tessera.operators import comms as C
from tessera.operators import evidence as E
from tessera.operators import graph as R
from tessera.operators import predicates as P
from tessera.operators import quality as Q
from tessera.operators import reviews as W
from tessera.operators import staging as G
from tessera.operators import temporal as T
from tessera.plans.knowledge import FOREST, forest_cut
from tessera.plans import relations, structure  # noqa: F401  (their queries come first)
from tessera.plans.requests import ORACLES, QUERIES, day, places, query, stamp, table
from tessera.sources import sinks
from tessera.streaming import ingest as S

# Staging: an event of each kind of fault follows from its key.


@query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'closed_flag_differs' END, CASE WHEN value >= 50 AND event_id % 5 = 0 THEN 'duration_differs' END, CASE WHEN event_id % 9 = 0 THEN 'missing_place' END], lambda x: x IS NOT NULL), '|') AS problems
FROM events
""")
def revalidated_rows(spark, folder):
    """Events as requests that a writer has normalised, with a wrong flag, duration or place here and there."""
    closed = F.col("value") >= 50
    hours = F.when(closed, F.col("value") + F.when(F.col("event_id") % 5 == 0, 1e-3).otherwise(1e-10))
    end = (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("decimal(18,6)") * 3600)).alias("end")
    rows = table(spark, folder, "events").select("event_id", "ts", "value", end, F.when(closed, "Closed").otherwise("open").alias("status"), (closed != (F.col("event_id") % 7 == 0)).alias("is_closed"), hours.alias("hours"), F.when(F.col("event_id") % 9 != 0, "x").otherwise(" ").alias("place"))
    return G.recomputed(rows, "status", "ts", "end", "is_closed", "hours", ["place"]).select("event_id", F.array_join("problems", "|").alias("problems"))


@query("""
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 2 END AS event, o_custkey AS doc, o_orderkey - o_orderkey % 4 AS version, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - o_orderkey % 4 ELSE o_orderkey - o_orderkey % 4 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END END AS content FROM orders),
a AS (SELECT *, min(content) OVER (PARTITION BY event) AS fe FROM e WHERE event IS NOT NULL), b AS (SELECT *, min(CASE WHEN content = fe THEN content END) OVER (PARTITION BY doc, version) AS fv, row_number() OVER (PARTITION BY event, content ORDER BY o_orderkey) AS copy FROM a)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN content <> fe THEN 'event_conflict' WHEN content <> fv THEN 'version_conflict' WHEN copy > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM b UNION ALL SELECT 'missing_event' FROM e WHERE event IS NULL) GROUP BY 1
""")
def event_staging(spark, folder):
    """Orders as events; two neighbours share an event id, four a version, a sixth of them with other content."""
    key, base = F.col("o_orderkey"), F.col("o_orderkey") - F.col("o_orderkey") % 4
    content = F.when(key % 2 == 0, base).otherwise(base + F.when(key % 3 == 0, 1).otherwise(0))
    events = table(spark, folder, "orders").select(F.when(key % 11 != 0, key - key % 2).alias("event"), F.col("o_custkey").alias("doc"), base.alias("version"), content.alias("content"))
    return Q.outcome_counts(G.staged_events(events, "event", "doc", "version", "content", ["doc"]))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN -1 ELSE doc_id END AS src, CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 1) ELSE substring(text, 11, 40) END AS q, CASE WHEN doc_id % 4 = 0 THEN 9 WHEN doc_id % 5 = 0 THEN 0 ELSE 10 END AS s FROM d)
SELECT doc_id, CASE WHEN src = -1 THEN 'missing_source' WHEN q = '' OR substring(text, s + 1, length(q)) <> q THEN 'wrong_span' WHEN (length(text) - length(replace(text, q, ''))) // length(q) > 1 THEN 'ambiguous_quote' WHEN doc_id % 7 = 0 THEN 'same_endpoints' ELSE 'accepted' END AS outcome FROM a
""")
def assertion_staging(spark, folder):
    """Assertions on every document; a short text has an empty quote or none at that place."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    start = F.when(i % 4 == 0, 9).when(i % 5 == 0, 0).otherwise(10)
    quote = F.when(i % 5 == 0, F.substring("text", 1, 1)).otherwise(F.substring("text", 11, 40))
    stated = docs.select(i.alias("item"), F.when(i % 6 == 0, -1).otherwise(i).alias("doc_id"), start.alias("s"), quote.alias("q"), F.lit("a").alias("subject"), F.when(i % 7 == 0, "a").otherwise("b").alias("object")).withColumn("e", F.col("s") + F.length("q"))
    return G.staged_assertions(stated, docs, "item", "doc_id", "s", "e", "q", "subject", "object", "text").select(F.col("item").alias("doc_id"), "outcome")


@query("SELECT CAST(c_nationkey AS BIGINT) AS batch, CASE c_nationkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'replayed' ELSE 'idempotency_conflict' END AS outcome FROM (SELECT DISTINCT c_nationkey FROM customer)")
def batch_keys(spark, folder):
    """Customers of a nation are a batch; a third was done before as it is, a third with a row less."""
    customer = table(spark, folder, "customer").select(F.col("c_nationkey").cast("long").alias("batch"), "c_custkey", "c_name")
    first = customer.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("c_custkey")))
    before = first.where("batch % 3 = 1 or (batch % 3 = 2 and place > 1)").select("batch", "c_custkey", "c_name")
    none = customer.select("batch").distinct().where("batch % 3 = 2").select("batch", F.lit("none").alias("payload"))  # a batch of one row
    done = G.batch_outcomes(before, none.limit(0), "batch", ["c_custkey", "c_name"]).select("batch", "payload")
    done = done.union(none.join(done.select(F.col("batch").alias("b")), F.col("batch") == F.col("b"), "left_anti"))
    return G.batch_outcomes(customer, done, "batch", ["c_custkey", "c_name"]).select("batch", "outcome")


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS \"unique\" FROM lineitem")
def distinct_key_check(spark, folder):
    return G.key_check(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def counts_by_kind(spark, folder):
    return G.counts_by(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


# Change ledgers: an event's item supersedes the one before it of its user, if its key says so.

ITEMS = """(SELECT event_id AS item, user_id AS doc, event_id // 40 AS version, ts, value > 80 AS hot, event_id % 6 = 0 AS planned, CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS prior, event_type FROM events)"""


def ledger(spark, folder) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, folder, "events").withColumn("prior", F.when(F.col("event_id") % 3 == 0, F.lag("event_id").over(own)))
    return events.select(F.col("event_id").alias("item"), F.col("user_id").alias("doc"), F.expr("event_id div 40").alias("version"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") > 80).alias("hot"), F.when(F.col("event_id") % 6 == 0, "planned").otherwise("reported").alias("modality"), F.array_compact(F.array("prior")).alias("supersedes"), "event_type", (F.col("event_id") % 5 == 0).alias("late"))


@query(f"""
WITH i AS MATERIALIZED {ITEMS}, b AS (SELECT *, hot AND item % 2 = 0 AS disputed FROM i WHERE ts < TIMESTAMP '2024-01-20'), a AS (SELECT *, hot AS disputed FROM i WHERE event_type <> 'error'),
n AS (SELECT a.*, p.item AS old, p.version AS pv FROM a LEFT JOIN b p ON p.item = a.prior WHERE a.item NOT IN (SELECT item FROM b)),
r AS (SELECT item, array_to_string(list_filter([CASE WHEN old IS NULL THEN 'new_support' WHEN pv = version THEN 'processing_discovery' ELSE 'correction' END, CASE WHEN item % 5 = 0 THEN 'late_evidence' END, CASE WHEN disputed THEN 'unresolved_conflict' END], lambda x: x IS NOT NULL), ',') AS categories FROM n),
c AS (SELECT a.item, CASE WHEN a.disputed THEN 'unresolved_conflict' ELSE 'assessment_change' END AS categories FROM a JOIN b USING (item) WHERE a.disputed <> b.disputed),
g AS (SELECT item, CASE doc % 3 WHEN 0 THEN 'retraction' WHEN 1 THEN 'source_revision' ELSE 'coverage_change' END AS categories FROM b WHERE item NOT IN (SELECT item FROM a) AND item NOT IN (SELECT old FROM n WHERE old IS NOT NULL))
SELECT categories, count(*) AS n, min(item) AS first_item FROM (SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM g) GROUP BY 1
""")
def knowledge_changes(spark, folder):
    items = ledger(spark, folder)
    before = items.where(F.col("ts") < stamp("2024-01-20")).withColumn("disputed", F.col("hot") & (F.col("item") % 2 == 0))
    after = items.where("event_type <> 'error'").withColumn("disputed", F.col("hot"))
    status = items.select("doc").distinct().withColumn("status", F.get(F.array(*map(F.lit, ["withdrawn", "superseded", "active"])), (F.col("doc") % 3).cast("int")))
    found = T.knowledge_changes(before, after, "item", "supersedes", "disputed", "version", "doc", "late", status)
    return found.groupBy("categories").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first_item"))


@query(f"""
WITH i AS MATERIALIZED {ITEMS}, b AS (SELECT * FROM i WHERE ts < TIMESTAMP '2024-01-10'), a AS (SELECT * FROM i WHERE ts >= TIMESTAMP '2024-01-25')
SELECT item, CASE WHEN doc IN (SELECT doc FROM b) THEN 'source_revision' ELSE 'new_support' END || CASE WHEN item % 5 = 0 THEN ',late_evidence' ELSE '' END || CASE WHEN hot THEN ',unresolved_conflict' ELSE '' END AS categories FROM a
UNION ALL SELECT item, 'coverage_change' FROM b WHERE doc NOT IN (SELECT doc FROM a)
""")
def source_changes(spark, folder):
    items = ledger(spark, folder).withColumn("disputed", F.col("hot"))
    none = items.select("doc", F.lit("").alias("status")).limit(0)
    return T.knowledge_changes(items.where(F.col("ts") < stamp("2024-01-10")), items.where(F.col("ts") >= stamp("2024-01-25")), "item", "supersedes", "disputed", "version", "doc", "late", none, source_mode=True)


@query(f"""
WITH i AS {ITEMS}, x AS (SELECT doc, item, bool_or(ts < TIMESTAMP '2024-01-20') AS b, bool_or(ts >= TIMESTAMP '2024-01-10') AS a, bool_or(planned) AS p, bool_or(hot) AS d FROM i GROUP BY ALL)
SELECT doc, CASE WHEN bool_or(p) THEN 'planned_transition' ELSE 'world_state_change' END || CASE WHEN bool_or(d) THEN ',unresolved_conflict' ELSE '' END AS categories FROM x GROUP BY 1 HAVING bool_or(a <> b)
""")
def world_changes(spark, folder):
    items = ledger(spark, folder)
    return T.world_changes(items.where(F.col("ts") < stamp("2024-01-20")), items.where(F.col("ts") >= stamp("2024-01-10")), "item", "doc", "modality", "hot")


# Charts, views and expansion.


def chart_tree(spark, folder) -> DataFrame:
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("person"), F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 3)), F.lit(" "), F.col("c_custkey") % 5).alias("name"))
    tree = forest_cut(spark, folder)
    return tree.join(people, F.col("child") == F.col("person")).select("child", "parent", "name", (F.col("status") == "cycle_conflict").alias("unresolved"))


CHART = f"""{FOREST}, t AS MATERIALIZED (SELECT child, parent, status = 'cycle_conflict' AS unresolved, upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2, 3)) || ' ' || c_custkey % 5 AS name FROM f JOIN customer ON c_custkey = child)"""


@query(f"""
{CHART}, up(node, anc) AS (SELECT child, child FROM t UNION ALL SELECT up.node, t.parent FROM up JOIN t ON t.child = up.anc WHERE t.parent IS NOT NULL), s AS (SELECT anc, count(*) AS n, sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS u FROM up JOIN t ON t.child = node GROUP BY 1)
SELECT child AS node, name, CASE WHEN n > 1 THEN 'branch' ELSE 'person' END AS kind, CASE WHEN n > 1 THEN n END AS person_count, CAST(CASE WHEN n > 1 THEN u END AS BIGINT) AS unresolved_count,
 row_number() OVER (ORDER BY n <= 1, lower(name), child) AS place FROM t JOIN s ON s.anc = child WHERE parent IS NULL
""")
def branch_chart(spark, folder):
    chart = R.branch_chart(chart_tree(spark, folder), "child", "parent", "name", "unresolved")
    return chart.select("node", "name", "kind", "person_count", "unresolved_count", (F.col("position") + 1).cast("long").alias("place"))


EXPANSION = """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS e, min('o' || l_orderkey) AS a, min('p' || l_partkey) AS b, max(l_quantity) AS q FROM lineitem GROUP BY 1), ends AS (SELECT DISTINCT e, unnest([a, b]) AS node FROM e),
s0 AS (SELECT e, 0 AS hop FROM e WHERE q >= 50 ORDER BY q DESC, e LIMIT 6), f1 AS (SELECT DISTINCT node FROM ends WHERE e IN (SELECT e FROM s0)),
v1 AS (SELECT *, row_number() OVER (ORDER BY node, e) AS visit FROM (SELECT node, e, row_number() OVER (PARTITION BY node ORDER BY e) AS r FROM ends WHERE node IN (SELECT node FROM f1)) WHERE r <= 4),
w1 AS (SELECT e, min(visit) AS visit FROM v1 WHERE visit <= 60 AND e NOT IN (SELECT e FROM s0) GROUP BY 1 ORDER BY 2 LIMIT 54), f2 AS (SELECT DISTINCT node FROM ends WHERE e IN (SELECT e FROM w1) AND node NOT IN (SELECT node FROM f1)),
v2 AS (SELECT *, row_number() OVER (ORDER BY node, e) AS visit FROM (SELECT node, e, row_number() OVER (PARTITION BY node ORDER BY e) AS r FROM ends WHERE node IN (SELECT node FROM f2)) WHERE r <= 4),
w2 AS (SELECT e, min(visit) AS visit FROM v2 WHERE visit <= 60 - (SELECT count(*) FROM v1 WHERE visit <= 60) AND e NOT IN (SELECT e FROM s0) AND e NOT IN (SELECT e FROM w1) GROUP BY 1 ORDER BY 2)
SELECT e AS edge, 0 AS hop FROM s0 UNION ALL SELECT e, 1 FROM w1 UNION ALL SELECT e, 2 FROM (SELECT * FROM w2 LIMIT greatest(0, 60 - 6 - (SELECT count(*) FROM w1)))"""


@query(EXPANSION)
def bounded_expansion(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"))
    items = rows.agg(F.min(F.concat(F.lit("o"), "l_orderkey")).alias("a"), F.min(F.concat(F.lit("p"), "l_partkey")).alias("b"), F.max("l_quantity").alias("l_quantity"))
    seeds = items.where("l_quantity >= 50").select("edge", F.col("l_quantity").alias("score")).orderBy(F.desc("score"), "edge").limit(6)
    return R.expanded(items, "edge", "a", "b", seeds, hops=2, per_node=4, most_edges=60)[0]


@query("""
SELECT count(*) AS assertions, count(DISTINCT l_orderkey) AS documents, (SELECT count(*) FROM (SELECT 'p' || l_partkey FROM lineitem UNION SELECT 's' || l_suppkey FROM lineitem)) AS entities, count(*) FILTER (l_quantity < 30) AS reported,
 count(*) FILTER (l_quantity >= 30 AND l_quantity < 40) AS planned, count(*) FILTER (l_quantity >= 40) AS negated, count(*) FILTER (l_discount > 0.05) AS disputed FROM lineitem
""")
def overview_counts(spark, folder):
    modality = F.when(F.col("l_quantity") < 30, "reported").when(F.col("l_quantity") < 40, "planned").otherwise("negated")
    rows = table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), "l_orderkey", modality.alias("modality"), (F.col("l_discount") > 0.05).alias("disputed"))
    return R.overview(rows, "item", "a", "b", "l_orderkey", "modality", "disputed")


@query("""
SELECT node, degree, label FROM (SELECT 's' || l_suppkey AS node, count(*) AS degree, min(s_nationkey % 3)::VARCHAR AS label FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 UNION ALL SELECT 'q' || CAST(l_quantity AS INTEGER), count(*), 'Q' FROM lineitem GROUP BY 1)
ORDER BY degree DESC, lower(label), node LIMIT 20
""")
def labelled_hubs(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("b"))
    labels = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), (F.col("s_nationkey") % 3).cast("string").alias("label"))
    labels = labels.union(rows.select("b", F.lit("Q")).distinct())
    return R.hubs(rows, "item", "a", "b", 20, labels)


# Pages and their chain.


@query("""
WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) AS place FROM orders), g AS (SELECT place // 100 AS page, min(place) AS start, count(*) AS items, arg_min(o_orderkey, place) AS first_item, arg_max(o_orderkey, place) AS last_item, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY place)) AS digest FROM p GROUP BY 1)
SELECT page, items, first_item, last_item, 'v1.' || page || '.' || start || '.' || coalesce(substring(lag(digest) OVER (ORDER BY page), 1, 16), '') AS cursor FROM g
""")
def paged_orders(spark, folder):
    """All orders by price in pages of a hundred; each page's cursor depends on the page before."""
    pages = G.numbered_pages(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)
    return G.page_chain(pages, "page", "place", "o_orderkey").select("page", "items", "first_item", "last_item", "cursor")


@query("""
WITH n AS (SELECT count(*) AS n FROM customer), p AS (SELECT DISTINCT (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS page FROM customer)
SELECT page, 'differs' AS fault FROM p WHERE page IN (1, 2) AND page < (SELECT max(page) FROM p) UNION ALL SELECT max(page), 'missing' FROM p HAVING max(page) > 0
""")
def chain_faults(spark, folder):
    """A replay of the customers' pages without the last one, in which a row of page 1 has changed; so page 2 names
    another page before it."""
    pages = G.numbered_pages(table(spark, folder, "customer").select("c_custkey"), [F.asc("c_custkey")], 50)
    whole = G.page_chain(pages, "page", "place", "c_custkey")
    changed = pages.withColumn("c_custkey", F.when(F.col("place") == 60, -1).otherwise(F.col("c_custkey")))
    last = pages.agg(F.max("page").alias("last")).first()["last"]
    return G.chain_faults(whole, G.page_chain(changed, "page", "place", "c_custkey").where(F.col("page") < last), "page")


@query("""
WITH RECURSIVE b AS MATERIALIZED (SELECT o_orderkey, row_number() OVER w - 1 AS i, sum(length(o_orderpriority) + o_orderkey % 97) OVER w AS upto, length(o_orderpriority) + o_orderkey % 97 AS s FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey)),
x AS MATERIALIZED (SELECT a.i, least(a.i + 40, coalesce(z.i, (SELECT count(*) FROM b))) AS nxt FROM b a ASOF LEFT JOIN b z ON a.upto - a.s + 2000 < z.upto),
p(page, start) AS (SELECT 0, 0::BIGINT WHERE EXISTS (SELECT 1 FROM b) UNION ALL SELECT page + 1, x.nxt FROM p JOIN x ON x.i = p.start WHERE x.nxt < (SELECT count(*) FROM b)),
l AS (SELECT page, start, coalesce(lead(start) OVER (ORDER BY page), (SELECT count(*) FROM b)) AS stop FROM p)
SELECT CAST(page AS BIGINT) AS page, count(*) AS items, CAST(sum(s) AS BIGINT) AS bytes, arg_min(o_orderkey, i) AS first_item, arg_max(o_orderkey, i) AS last_item FROM l JOIN b ON b.i >= l.start AND b.i < l.stop GROUP BY 1
""")
def paged_by_bytes(spark, folder):
    """All orders by price in pages of at most 40 rows and 2,000 bytes."""
    size = F.length("o_orderpriority") + F.col("o_orderkey") % 97
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", size.cast("long").alias("s"))
    pages = G.byte_pages(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("s"), 40, 2000)
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("items"), F.sum("s").alias("bytes"), F.min_by("o_orderkey", "place").alias("first_item"), F.max_by("o_orderkey", "place").alias("last_item"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_custkey % 13 <> 0) AS located, count(*) FILTER (c_custkey % 13 = 0) AS unlocated FROM customer GROUP BY 1")
def located_counts(spark, folder):
    rows = places(spark, folder).withColumn("lat", F.when(F.col("c_custkey") % 13 != 0, F.col("lat"))).join(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return A.located(rows, ["c_mktsegment"], "lat", "lon")


@query("SELECT o_orderkey, s.n_name AS subject, o.n_name AS object FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation s ON s.n_nationkey = c_nationkey LEFT JOIN nation o ON o.n_nationkey = o_orderkey % 40")
def edge_names(spark, folder):
    """Edges with the names of both ends, null for ends that nothing names."""
    edges = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_nationkey").cast("long").alias("a"), (F.col("o_orderkey") % 40).alias("b"))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("node"), "n_name")
    return E.named_ends(edges, "a", "b", names, "node", "n_name").select("o_orderkey", F.col("a_name").alias("subject"), F.col("b_name").alias("object"))


@query("SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'en'")
def document_assertions(spark, folder):
    docs = table(spark, folder, "documents").where("lang = 'en'").select("doc_id")
    return E.of_documents(table(spark, folder, "labels"), docs, "doc_id").select("doc_id", "quality", "toxic")


@query("""
SELECT count(*) AS n, sum(quality)::BIGINT AS positives, round(avg((p - quality) ** 2), 8) AS brier, round(-avg(quality * ln(s) + (1 - quality) * ln(1 - s)), 8) AS log_loss,
 (SELECT round(sum(abs(ps - qs)) / sum(n), 8) FROM (SELECT sum(p) AS ps, sum(quality) AS qs, count(*) AS n FROM (SELECT 1 / (1 + exp(-(n_chars % 1000 / 250.0 - 2))) AS p, quality FROM documents JOIN labels USING (doc_id)) GROUP BY least(9, floor(p * 10)))) AS calibration_error
FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS s FROM (SELECT 1 / (1 + exp(-(n_chars % 1000 / 250.0 - 2))) AS p, quality FROM documents JOIN labels USING (doc_id)))
""")
def calibration_scores(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(A.sigmoid(F.col("n_chars") % 1000 / 250.0 - 2).alias("p"), "quality")
    return A.calibration_scores(rows, "p", "quality").withColumns({c: F.round(c, 8) for c in ("brier", "log_loss", "calibration_error")})


# Gates and releases.


@query("""
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 2) THEN DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) END AS b, CASE WHEN c_custkey % 4 >= 2 THEN DATE '2024-02-01' - CAST(c_custkey % 25 AS INTEGER) END AS e FROM customer)
SELECT c_custkey, (b IS NOT NULL OR e IS NOT NULL) AND coalesce(b <= DATE '2024-01-15', true) AND coalesce(DATE '2024-01-15' < e, true) AS eligible,
 greatest(coalesce(b, DATE '0001-01-01'), DATE '2024-01-05') < least(coalesce(e, DATE '9999-12-31'), DATE '2024-01-10') AS overlaps FROM d
""")
def day_eligibility(spark, folder):
    """Validity days by key: none, from a day on, from a day until another, until a day; on a day, and over an interval."""
    i = F.col("c_custkey")
    start = F.when(i % 4 % 3 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")))
    end = F.when(i % 4 >= 2, F.date_sub(F.lit("2024-02-01").cast("date"), (i % 25).cast("int")))
    rows = table(spark, folder, "customer").select("c_custkey", start.alias("b"), end.alias("e"))
    d = [F.lit(x).cast("date") for x in ("2024-01-05", "2024-01-10", "0001-01-01", "9999-12-31", "2024-01-15")]
    return rows.select("c_custkey", T.eligible_on(F.col("b"), F.col("e"), d[4]).alias("eligible"), T.overlap((F.col("b"), F.col("e")), (d[0], d[1]), d[2], d[3]).alias("overlaps"))


@query("""
WITH m AS (SELECT o_orderkey AS m, o_custkey AS s, o_orderdate AS t, list_sort(list(DISTINCT l_partkey)) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT m AS message FROM m WHERE len(r) <= 20 AND t <= TIMESTAMP '1996-01-01' AND s % 9 <> 0
""")
def usable_messages(spark, folder):
    """Orders as messages to their parts, each given twice; some have no sender, some come after the day."""
    to = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("to"))
    sent = to.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("message"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("sender"), "to", F.col("o_orderdate").alias("sent"))
    twice = sent.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2))))
    return C.usable(twice, "message", "sender", "to", "sent", stamp("1996-01-01"), [F.col("arrival")]).select("message")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def reconciled_groups(spark, folder):
    orders = table(spark, folder, "orders")
    return A.reconciled(A.grouped(orders, ["o_orderpriority"], {"n": F.count(F.lit(1))}), orders.count())


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1")
def last_month_events(spark, folder):
    """The month before a day, as UTC; the table is checked to cover it, the columns to be allowed."""
    events = table(spark, folder, "events")
    start, end = P.last_month(datetime(2024, 2, 10, tzinfo=timezone.utc), "UTC")
    cover = events.agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("gte"), F.date_format(F.date_add(F.max("ts"), 7), "yyyy-MM-dd").alias("lt")).first()
    P.require_coverage({"complete": True, "gte": cover["gte"], "lt": cover["lt"]}, start.strftime("%Y-%m-%d"), cover["lt"])
    rows = P.project(events, ["ts", "event_id"], events.columns).where(P.half_open("ts", stamp(start.strftime("%Y-%m-%d")), stamp(end.strftime("%Y-%m-%d"))))
    return rows.groupBy(day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0
""")
def released_records(spark, folder):
    """Approved by the latest review (some approvals are taken back), unchanged since, and not revoked."""
    records = table(spark, folder, "customer").withColumn("fingerprint", X.fingerprint("c_custkey", "c_name"))
    i = F.col("c_custkey")
    first = records.select("c_custkey", F.lit(1).alias("seq"), F.when(i % 3 == 0, "approved").otherwise("rejected").alias("decision"), "fingerprint")
    second = records.where("c_custkey % 5 = 0").select("c_custkey", F.lit(2).alias("seq"), F.lit("withheld").alias("decision"), "fingerprint")
    shown = sinks.released(records, first.union(second), "c_custkey", ["c_custkey", "c_name"])
    return W.permitted(shown, "c_custkey", records.where("c_custkey % 11 = 0"), "c_custkey")


@query("SELECT doc_id, doc_id % 3 = 0 AND doc_id % 4 > 0 AND text IS NOT NULL AS sound, CASE WHEN doc_id % 5 > 0 THEN substring(text, 6, 20) END AS shown FROM documents")
def verified_citations(spark, folder):
    """Citations of documents: two thirds have another quote, a quarter another hash; a fifth of the sources is withdrawn."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    cited = docs.select("doc_id", F.lit(5).alias("start"), F.lit(25).alias("end"), F.when(i % 3 == 0, F.substring("text", 6, 20)).otherwise(F.concat(F.substring("text", 6, 19), F.lit("\\u0001"))).alias("quote"), F.when(i % 4 > 0, X.text_hash(F.col("text"))).otherwise("none").alias("sha256"))
    checked = sinks.verified_citations(cited, docs).select("doc_id", "sound")
    return checked.join(docs, "doc_id").select("doc_id", "sound", W.redacted(i % 5 > 0, F.substring("text", 6, 20)).alias("shown"))


@query("SELECT doc_id, coalesce(length(text) > 0 AND (length(text) - length(replace(text, substring(text, 1, 6), ''))) // length(substring(text, 1, 6)) = 1, false) AS grounded FROM documents")
def grounded_quotes(spark, folder):
    """Whether each document's first six characters, or all it has, stand there once; an empty text grounds nothing."""
    quote = F.substring("text", 1, 6)
    return table(spark, folder, "documents").select("doc_id", F.coalesce(X.occurrences(F.col("text"), quote) == 1, F.lit(False)).alias("grounded"))


@query("SELECT o_custkey AS low, c_nationkey + 1000000 AS high, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 GROUP BY ALL")
def approval_pairs(spark, folder):
    """Orders as messages to their customer's nation; a third asks for approval, some of them two known people."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    chief = (F.col("c_nationkey") + 1_000_000).cast("long")
    to = F.when(F.col("o_orderkey") % 4 > 0, F.array(chief, F.lit(-5).cast("long"))).otherwise(F.array(chief, F.lit(1_000_100).cast("long")))
    said = orders.select(F.col("o_custkey").alias("sender"), to.alias("to"), F.when(F.col("o_orderkey") % 3 == 0, "Please approve this.").otherwise("Approved last week? No: approximately.").alias("text"))
    said = said.withColumn("text", F.when(F.col("text").startswith("Please"), F.col("text")).otherwise("all is well"))
    known = spark.range(101).select((F.col("id") + 1_000_000).alias("person"))
    found = E.approval_pairs(said, "sender", "to", "text", known, "person")
    return found.select("low", "high", "n")


@query("""
WITH v AS (SELECT o_orderkey AS v, CASE WHEN o_orderkey % 10 = 7 THEN -1 WHEN o_orderkey % 20 = 5 THEN (SELECT max(o_orderkey) FROM orders) + 1 + o_orderkey ELSE NULL END AS p FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + 1 + o_orderkey, CASE WHEN o_orderkey % 40 = 5 THEN o_orderkey END FROM orders WHERE o_orderkey % 20 = 5)
SELECT v, CASE WHEN p = -1 THEN 'missing_parent' ELSE 'cycle' END AS problem FROM v WHERE p = -1 OR (p IS NOT NULL AND EXISTS (SELECT 1 FROM v w WHERE w.v = v.p AND w.p = v.v))
""")
def revision_chains(spark, folder):
    """Orders as versions: some name a parent that is missing, some pairs name each other."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    top = (orders.agg(F.max("o_orderkey").alias("n")).first()["n"] or 0) + 1
    i = F.col("o_orderkey")
    first = orders.select(i.alias("v"), F.when(i % 10 == 7, -1).when(i % 20 == 5, i + top).alias("p"))
    second = orders.where("o_orderkey % 20 = 5").select((i + top).alias("v"), F.when(i % 40 == 5, i).alias("p"))
    return T.chain_problems(first.union(second), "v", "p")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def first_event_versions(spark, folder):
    """The events as a file stream, appended to an event log in which the first version of a user's event wins."""
    from tessera.session import shared_folder

    schema = table(spark, folder, "events").schema
    stream = S.file_stream(spark, f"{folder}/events.parque[t]", schema, kind="parquet")
    place = S.new_place(shared_folder(spark))
    S.ingest_once(stream.select("user_id", "event_id", "ts"), f"{place}/log", f"{place}/checkpoint", "user_id", "event_id").awaitTermination()
    return S.read_log(spark, f"{place}/log", "user_id long, event_id long").select("user_id", "event_id")


@query("""
WITH e AS (SELECT event_id AS seq, user_id AS doc, CASE WHEN event_id % 17 = 0 THEN 'withdraw' ELSE 'upsert' END AS op, CASE WHEN event_id % 4 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS prior FROM events),
g AS (SELECT doc, max(seq) AS gone FROM e WHERE op = 'withdraw' GROUP BY 1), a AS (SELECT e.* FROM e LEFT JOIN g USING (doc) WHERE op = 'upsert' AND (gone IS NULL OR seq > gone))
SELECT doc AS user_id, seq AS event_id FROM a WHERE seq NOT IN (SELECT prior FROM a WHERE prior IS NOT NULL)
""")
def standing_stream_events(spark, folder):
    """Events as upserts, corrections of the one before and withdrawals: what stands of the log."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    log = table(spark, folder, "events").withColumns({"operation": F.when(F.col("event_id") % 17 == 0, "withdraw").otherwise("upsert"), "supersedes": F.when(F.col("event_id") % 4 == 0, F.lag("event_id").over(own))})
    return S.standing_events(log, "user_id", "event_id", "operation", "supersedes").select("user_id", "event_id")


@query("""
SELECT c_mktsegment, count(DISTINCT n_name) AS n_values, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS vals FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 GROUP BY 1 HAVING count(DISTINCT n_name) > 1
""")
def conflict_packet(spark, folder):
    """What the customers of a region's nations say of their segment's nation."""
    nation = table(spark, folder, "nation")
    edges = nation.selectExpr("concat('r', n_regionkey) as src", "concat('n', n_nationkey) as dst")
    target = table(spark, folder, "region").where("r_regionkey = 1").selectExpr("concat('r', r_regionkey) as node")
    said = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "concat('n', c_nationkey) as entity", "c_mktsegment", "n_name")
    return E.conflict_packet(edges, target, 1, said, "entity", "c_custkey", ["c_mktsegment"], "n_name")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Corrected' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 IN (0, 1)
""")
def approved_corrections(spark, folder):
    customer = table(spark, folder, "customer").withColumn("print", X.text_hash(F.col("c_name")))
    decided = customer.where("c_custkey % 4 < 3").select("c_custkey", F.when(F.col("c_custkey") % 4 < 2, "approved").otherwise("rejected").alias("decision"), F.col("print").alias("reviewed_print"))
    states = W.review_states(customer, decided, "c_custkey", "print").where("review_state = 'approved'")
    fixes = customer.where("c_custkey % 4 = 0").select("c_custkey", F.lit("Corrected").alias("c_mktsegment"))
    return W.corrected(states, fixes, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


__all__ = ["ORACLES", "QUERIES"]
