"""Registered queries on texts, vectors, versions, graphs, messages and facts. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import aggregates as A
from tessera.operators import comms as C
from tessera.operators import evidence as E
from tessera.operators import graph as R
from tessera.operators import intervals as I
from tessera.operators import reviews as W
from tessera.operators import temporal as T
from tessera.plans.requests import ORACLES, QUERIES, query, stamp, table

DOC_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+(?:[-.][\\p{L}\\p{M}\\p{N}_]+)*')"
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"


@query("""
SELECT doc_id, CAST(s AS INTEGER) AS start, length(substring(text, CAST(s AS BIGINT) + 1, 1200)) AS chars, sha256(substring(text, CAST(s AS BIGINT) + 1, 1200)) AS mark
FROM (SELECT doc_id, text, unnest(range(0, length(text), 1200)) AS s FROM documents)
""")
def chunk_documents(spark, folder):
    return X.chunks(table(spark, folder, "documents")).select("doc_id", "start", F.length("chunk").cast("long").alias("chars"), X.text_hash(F.col("chunk")).alias("mark"))


@query(f"SELECT doc_id, len({WORDS}) AS n_tokens, len(list_distinct({WORDS})) AS n_distinct FROM documents")
def token_counts(spark, folder):
    found = X.tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@query(f"""
SELECT doc_id, round((least(3, len(list_filter(w, lambda x: x = 'the'))) + least(3, len(list_filter(w, lambda x: x = 'that'))) + least(3, len(list_filter(w, lambda x: x = 'license')))) / 3.0
  + CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'lic'))) > 0 THEN 0.5 ELSE 0 END, 8) AS score
FROM (SELECT doc_id, {WORDS} AS w FROM documents)
""")
def lexical_score(spark, folder):
    score = X.lexical_score(X.tokens(F.col("text")), ["the", "that", "license"], prefix="lic")
    return table(spark, folder, "documents").select("doc_id", F.round(score, 8).alias("score"))


TERMS = ["licensed", "reserved", "the", "license"]
TERM_LIST = "('licensed', 'reserved', 'the', 'license')"


@query(f"""
WITH w AS (SELECT doc_id, {DOC_WORDS} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term FROM w), f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN {TERM_LIST} GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
s AS (SELECT doc_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / n.a))) AS score FROM f JOIN d USING (term) JOIN w USING (doc_id) CROSS JOIN n GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 50
""")
def bm25_ranking(spark, folder):
    out = X.bm25(table(spark, folder, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"""
WITH t AS (SELECT doc_id, unnest({DOC_WORDS}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents), q AS (SELECT term, (1 + ln(1)) * (1 + ln((n + 1) / CAST(df + 1 AS DOUBLE))) AS q FROM d, n WHERE term IN {TERM_LIST}),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (1 + ln((n + 1) / CAST(df + 1 AS DOUBLE))) AS w FROM f JOIN d USING (term), n),
s AS (SELECT doc_id, sum(w * coalesce(q, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(q * q)) FROM q)) AS score FROM w LEFT JOIN q USING (term) GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0
""")
def tfidf_cosine(spark, folder):
    return X.tfidf_cosine(table(spark, folder, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS score
FROM embeddings WHERE vec_id <> 3 ORDER BY 2 DESC, 1 LIMIT 25
""")
def cosine_topk(spark, folder):
    return V.cosine_top(table(spark, folder, "embeddings"), 3, 25).select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) DESC, vec_id) AS r FROM embeddings WHERE vec_id <> 3),
b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings ORDER BY label DESC, vec_id LIMIT 25)
SELECT vec_id, round(sum(1.0 / (60 + r)), 10) AS fused FROM (SELECT * FROM a WHERE r <= 25 UNION ALL SELECT * FROM b) GROUP BY 1
""")
def rrf_fusion(spark, folder):
    vectors = table(spark, folder, "embeddings")
    by_label = vectors.select("vec_id", F.col("label").cast("double").alias("score")).orderBy(F.desc("score"), "vec_id").limit(25)
    fused = X.fuse([V.cosine_top(vectors, 3, 25), by_label], "vec_id")
    return fused.select("vec_id", F.round("fused", 10).alias("fused"))


@query("SELECT doc_id, sha256(text) AS mark, substring(text, 4, 9) = substring(text, 4, 9) AND length(text) >= 12 AS span_ok FROM documents")
def span_check(spark, folder):
    docs = table(spark, folder, "documents").withColumn("quote", F.expr("substring(text, 4, 9)"))
    ok = X.span_is(F.col("text"), F.lit(3), F.lit(12), F.col("quote")) & (F.length("text") >= 12)
    return docs.select("doc_id", X.text_hash(F.col("text")).alias("mark"), ok.alias("span_ok"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages
""")
def html_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.html_text(F.col("html")).alias("plain"))


@query(r"""
SELECT sha256(c) AS mark, min(length(c)) AS chars, count(*) AS n FROM (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS c FROM documents) GROUP BY 1 HAVING count(*) > 1
""")
def collapsed_texts(spark, folder):
    """Whole texts that are the same but for case and white space."""
    collapsed = table(spark, folder, "documents").select(X.collapse(F.col("text")).alias("c"))
    return collapsed.select(X.text_hash(F.col("c")).alias("mark"), F.length("c").cast("long").alias("chars")).groupBy("mark").agg(F.min("chars").alias("chars"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_retailprice * 1000, 0) WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5 ELSE NULL END AS parsed FROM part
""")
def number_values(spark, folder):
    part = table(spark, folder, "part")
    kind = F.col("p_partkey") % 4
    shown = F.when(kind == 0, F.format_number(F.round(F.col("p_retailprice") * 1000, 0), 0)).when(kind == 1, F.concat(F.lit(" "), F.col("p_size"))).when(kind == 2, F.concat(F.col("p_size"), F.lit(" 1/2"))).otherwise("n/a")
    return part.select("p_partkey", X.number_value(shown).alias("parsed"))


# Versions and time: a customer's orders are versions, each supersedes the one before it.


def order_versions(spark, folder) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").withColumn("before", F.lag("o_orderkey").over(own))


def last_key(orders: DataFrame, share: int, of: int) -> int:
    """The sequence number at a share of the highest: as-of cuts that move with the table."""
    return (orders.agg(F.max("o_orderkey").alias("n")).first()["n"] or 0) * share // of


VERSIONS = "(SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)"


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) * 2 // 3 FROM orders) AND o_orderdate <= TIMESTAMP '1996-01-01'
 AND o_orderdate <= TIMESTAMP '1995-06-15' AND (o_orderstatus = 'O' OR TIMESTAMP '1995-06-15' < o_orderdate + INTERVAL 400 DAY) AND o_orderstatus <> 'P'
""")
def bitemporal_slice(spark, folder):
    orders = table(spark, folder, "orders")
    known = T.known_at(orders, "o_orderkey", "o_orderdate", last_key(orders, 2, 3), stamp("1996-01-01"))
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS"))
    return known.where(T.valid_at(F.col("o_orderdate"), end, stamp("1995-06-15"), end_known=F.col("o_orderstatus") != "P")).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) * 3 // 4 FROM orders) GROUP BY 1")
def latest_status_asof(spark, folder):
    orders = table(spark, folder, "orders")
    return T.latest_as_of(orders, ["o_custkey"], "o_orderkey", "o_orderstatus", last_key(orders, 3, 4))


@query(f"""
WITH v AS {VERSIONS}, s AS (SELECT v.*, EXISTS (SELECT 1 FROM v r WHERE r.before = v.o_orderkey) AS replaced FROM v)
SELECT CASE WHEN c_acctbal < 0 THEN 'withdrawn' WHEN replaced THEN 'superseded' ELSE 'active' END AS status, count(*) AS n FROM s JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def lifecycle_status(spark, folder):
    withdrawn = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return T.lifecycle(order_versions(spark, folder), withdrawn, "o_orderkey", "before", "o_custkey").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH v AS {VERSIONS} SELECT o_orderkey FROM v WHERE o_orderkey NOT IN (SELECT before FROM v WHERE before IS NOT NULL)")
def supersede_anti(spark, folder):
    named = order_versions(spark, folder).withColumn("supersedes", F.array_compact(F.array("before")))
    return T.not_superseded(named, "o_orderkey", "supersedes").select("o_orderkey")


@query("""
WITH r AS (SELECT *, o_orderdate AS b, o_orderdate + INTERVAL 30 DAY AS e FROM orders)
SELECT r.o_orderkey, EXISTS (SELECT 1 FROM r x WHERE x.o_custkey = r.o_custkey AND x.o_orderpriority <> r.o_orderpriority AND x.b < r.e AND r.b < x.e) AS disputed FROM r
""")
def interval_disputes(spark, folder):
    rows = table(spark, folder, "orders").withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return T.disputed(rows, "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "until")


@query("""
WITH b AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN a.n <> b.n OR a.s <> b.s THEN 'changed' ELSE 'unchanged' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def snapshot_diff(spark, folder):
    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s"))

    orders = table(spark, folder, "orders")
    return T.snapshot_changes(state(orders.where(F.col("o_orderdate") < stamp("1997-01-01"))), state(orders.where(F.col("o_orderdate") >= stamp("1993-01-01"))), ["o_custkey"], ["n", "s"])


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, value FROM events), b AS (SELECT user_id AS i, arg_max(event_type, event_id) AS s, max(value) AS v FROM e WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
a AS (SELECT user_id AS i, arg_max(event_type, event_id) AS s, max(value) AS v, min(ts) AS av FROM e WHERE ts >= TIMESTAMP '2024-01-04' GROUP BY 1),
j AS (SELECT coalesce(a.i, b.i) AS item, b.i IS NULL AS isnew, a.i IS NULL AS gone, a.s = 'error' AND b.s IS DISTINCT FROM 'error' AS wd, a.s IS DISTINCT FROM b.s AS sd, a.v IS DISTINCT FROM b.v AS vd, a.av < TIMESTAMP '2024-01-20' AS late FROM a FULL JOIN b ON a.i = b.i),
c AS (SELECT item, array_to_string(list_filter([CASE WHEN NOT isnew AND NOT gone AND NOT coalesce(wd, false) AND sd THEN 'assessment_change' END, CASE WHEN NOT isnew AND NOT gone AND vd THEN 'correction' END,
  CASE WHEN isnew AND late THEN 'late_evidence' END, CASE WHEN isnew THEN 'new_support' END, CASE WHEN NOT isnew AND (gone OR coalesce(wd, false)) THEN 'retraction' END], lambda x: x IS NOT NULL), ',') AS categories FROM j)
SELECT item AS user_id, categories FROM c WHERE categories <> ''
""")
def change_categories(spark, folder):
    events = table(spark, folder, "events")

    def state(rows: DataFrame) -> DataFrame:
        status = F.max_by("event_type", "event_id")
        return rows.groupBy("user_id").agg(F.when(status == "error", "withdrawn").otherwise(status).alias("status"), F.max("value").alias("value"), F.min("ts").alias("available"), F.lit("2024-01-20").cast("timestamp_ntz").alias("ingested"))

    return T.change_categories(state(events.where(F.col("ts") < stamp("2024-01-16"))), state(events.where(F.col("ts") >= stamp("2024-01-04"))), "user_id", "status", "value", "available", "ingested")


# Graphs: region -> nation -> customer -> order, and customers pointing to others by arithmetic.


def place_edges(spark, folder) -> DataFrame:
    nation = table(spark, folder, "nation").selectExpr("concat('r', n_regionkey) as src", "concat('n', n_nationkey) as dst")
    customer = table(spark, folder, "customer").selectExpr("concat('n', c_nationkey) as src", "concat('c', c_custkey) as dst")
    orders = table(spark, folder, "orders").selectExpr("concat('c', o_custkey) as src", "concat('o', o_orderkey) as dst")
    back = table(spark, folder, "nation").where("n_nationkey % 7 = 0").selectExpr("concat('n', n_nationkey) as src", "concat('r', n_regionkey) as dst")
    return nation.union(customer).union(orders).union(back)


EDGES = """(SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer
 UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation WHERE n_nationkey % 7 = 0)"""


@query(f"""
WITH RECURSIVE e AS {EDGES}, b(node, hop) AS (SELECT 'r1', 0 UNION SELECT e.dst, b.hop + 1 FROM b JOIN e ON e.src = b.node WHERE b.hop < 3)
SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY 1
""")
def khop_bfs(spark, folder):
    seeds = table(spark, folder, "region").where("r_regionkey = 1").selectExpr("concat('r', r_regionkey) as node")
    return R.reachable(place_edges(spark, folder), seeds, 3)


@query("SELECT node, count(*) AS degree FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, unnest([concat('p', l_partkey), concat('s', l_suppkey)]) AS node FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hub_degree(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey) as item", "concat('p', l_partkey) as a", "concat('s', l_suppkey) as b").distinct()
    return R.hubs(rows, "item", "a", "b", 20)


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def hop_budget(spark, folder):
    return R.per_node(table(spark, folder, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


def manager_candidates(spark, folder) -> DataFrame:
    """Two candidates for each customer, by arithmetic on the key; the second has the higher priority for some."""
    customer = table(spark, folder, "customer")
    both = customer.withColumn("n", F.lit(customer.agg(F.max("c_custkey").alias("n")).first()["n"]))
    first = both.selectExpr("c_custkey as child", "c_custkey * 7 % n + 1 as parent", "2 as priority", "c_acctbal as score")
    second = both.where("c_custkey % 3 = 0").selectExpr("c_custkey as child", "cast(floor(c_custkey / 3) as bigint) + 1 as parent", "1 as priority", "c_acctbal as score")
    return first.union(second)


FOREST = """WITH RECURSIVE n AS (SELECT max(c_custkey) AS n FROM customer), k AS (SELECT c_custkey AS child, c_custkey * 7 % n + 1 AS parent, 2 AS priority, c_acctbal AS score FROM customer, n
 UNION ALL SELECT c_custkey, CAST(floor(c_custkey / 3) AS BIGINT) + 1, 1, c_acctbal FROM customer WHERE c_custkey % 3 = 0),
c AS MATERIALIZED (SELECT child, parent, priority, score FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY priority, score DESC, parent) AS r FROM k) WHERE r = 1),
w(start, pos, step) AS (SELECT child, parent, 1 FROM c UNION ALL SELECT w.start, c.parent, step + 1 FROM w JOIN c ON c.child = w.pos WHERE w.pos <> w.start AND step <= (SELECT n FROM n)),
cyc AS (SELECT start AS node, max(step) AS len FROM w WHERE pos = start GROUP BY 1),
m(node, pos, low, step) AS (SELECT c.child, c.parent, least(c.child, c.parent), 1 FROM c JOIN cyc ON cyc.node = c.child UNION ALL SELECT m.node, c.parent, least(m.low, c.parent), step + 1 FROM m JOIN c ON c.child = m.pos WHERE m.pos <> m.node),
ring AS (SELECT node, min(low) AS cycle FROM m GROUP BY 1),
cut AS (SELECT node FROM (SELECT node, row_number() OVER (PARTITION BY cycle ORDER BY priority DESC, score, node DESC) AS r FROM ring JOIN c ON c.child = ring.node) WHERE r = 1),
f AS (SELECT child, CASE WHEN cut.node IS NULL THEN parent END AS parent, CASE WHEN cut.node IS NULL THEN 'selected' ELSE 'cycle_conflict' END AS status FROM c LEFT JOIN cut ON cut.node = c.child)"""


@query(f"{FOREST} SELECT * FROM f")
def forest_cut(spark, folder):
    return R.forest(manager_candidates(spark, folder), "child", "parent", "priority", "score")


@query(f"""
{FOREST}, up(node, anc, steps) AS (SELECT child, parent, 1 FROM f WHERE parent IS NOT NULL UNION ALL SELECT up.node, f.parent, steps + 1 FROM up JOIN f ON f.child = up.anc WHERE f.parent IS NOT NULL)
SELECT child AS node, 1 + coalesce(n, 0) AS subtree, CAST(coalesce(d, 0) AS INTEGER) AS depth FROM f LEFT JOIN (SELECT anc, count(*) AS n, max(steps) AS d FROM up GROUP BY 1) s ON s.anc = f.child
""")
def subtree_size(spark, folder):
    return R.subtree_sizes(forest_cut(spark, folder), "child", "parent")


@query("""
WITH RECURSIVE o AS MATERIALIZED (SELECT DISTINCT o_custkey AS c, CAST(floor(o_totalprice / 10) AS BIGINT) AS p FROM orders), h AS (SELECT p, min(c) AS l FROM o GROUP BY p),
e AS MATERIALIZED (SELECT c AS x, l AS y FROM o JOIN h USING (p) WHERE c <> l UNION SELECT l, c FROM o JOIN h USING (p) WHERE c <> l),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT c, c FROM o UNION SELECT e.y, min(cc.component) FROM cc JOIN e ON e.x = cc.node JOIN recurring.cc r ON r.node = e.y WHERE cc.component < r.component GROUP BY e.y)
SELECT component, node FROM cc
""")
def linked_components(spark, folder):
    """Customers linked by orders of about the same price; the links go through the price, not through pairs. A few
    components hold most of them, others one or two."""
    rows = table(spark, folder, "orders").selectExpr("o_custkey as c", "cast(floor(o_totalprice / 10) as bigint) as p")
    first = rows.groupBy("p").agg(F.min("c").alias("low"))
    return R.components(rows.join(first, "p").select("c", "low"), "c", "low").select("component", "node")


# Messages: a line item is a message from its customer's nation to its supplier's.


def messages(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("sender"), F.col("s_nationkey").alias("recipient"))


PAIRS = "(SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS sent FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)"


@query(f"""
SELECT CAST(p AS INTEGER) AS person, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(r) AS BIGINT) AS received, count(DISTINCT c) AS breadth
FROM (SELECT a AS p, b AS c, sent AS s, 0 AS r FROM {PAIRS} UNION ALL SELECT b, a, 0, sent FROM {PAIRS}) GROUP BY 1
""")
def pair_metrics(spark, folder):
    return C.person_metrics(C.directed_pairs(messages(spark, folder), "sender", "recipient"))


@query(f"""
WITH u AS (SELECT least(a, b) AS low, greatest(a, b) AS high, CAST(sum(sent) AS BIGINT) AS total, sum(CASE WHEN a < b THEN sent ELSE 0 END) AS up, sum(CASE WHEN a > b THEN sent ELSE 0 END) AS down FROM {PAIRS} GROUP BY ALL)
SELECT low, high, total, round(least(0.52, 0.08 + 0.20 * total / (SELECT max(total) FROM u) + 0.14 * least(up, down) / greatest(up, down) + 0.10 * least(1.0, ln(1 + total) / ln(11.0))), 8) AS score FROM u
""")
def reciprocity_score(spark, folder):
    pairs = C.undirected_pairs(C.directed_pairs(messages(spark, folder), "sender", "recipient"))
    most = F.lit(pairs.agg(F.max("total").alias("most")).first()["most"])
    return pairs.select("low", "high", "total", F.round(C.contact_score(F.col("total") / most, F.col("reciprocity"), F.col("total")), 8).alias("score"))


@query(f"""
SELECT person, contact, CAST(traffic AS BIGINT) AS traffic, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY traffic DESC, contact) AS place
FROM (SELECT p AS person, c AS contact, sum(s) AS traffic FROM (SELECT a AS p, b AS c, sent AS s FROM {PAIRS} UNION ALL SELECT b, a, sent FROM {PAIRS}) GROUP BY ALL)) WHERE place <= 8
""")
def top_contacts(spark, folder):
    return C.top_contacts(C.directed_pairs(messages(spark, folder), "sender", "recipient"))


@query("SELECT conv_id, turn, count(*) AS own_lines FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE NOT regexp_matches(l, '^\\s*>') GROUP BY ALL")
def unquoted_lines(spark, folder):
    rows = table(spark, folder, "conversations").select(F.struct("conv_id", "turn").alias("message"), "text")
    return C.unquoted_lines(rows, "message", "text").groupBy("message").agg(F.count(F.lit(1)).alias("own_lines")).select("message.conv_id", "message.turn", "own_lines")


@query("""
WITH a AS (SELECT lower(c_mktsegment) || ' ' || c_custkey // 3 AS k, min(c_custkey) AS c, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)
SELECT m.c_custkey AS mention, a.c AS person FROM customer m JOIN a ON a.k = lower(m.c_mktsegment) || ' ' || (m.c_custkey + 1) // 3 WHERE a.n = 1
""")
def unique_alias_join(spark, folder):
    """Each customer goes by its segment and a third of its key, which a neighbour may share."""
    customer = table(spark, folder, "customer")
    aliases = customer.selectExpr("concat(c_mktsegment, '  ', c_custkey div 3) as name", "c_custkey as person")
    mentions = customer.selectExpr("c_custkey as mention", "concat(lower(c_mktsegment), ' ', (c_custkey + 1) div 3) as said")
    return C.alias_matches(mentions, "said", aliases, "name", "person").select("mention", "person")


# Facts: a part's size, with a tolerance that follows from its key.


def part_facts(spark, folder) -> DataFrame:
    part = table(spark, folder, "part")
    low, high = I.bounds(F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 4.0), (F.col("p_partkey") % 3).cast("double"), F.lit(1.0), F.col("p_partkey") % 11 == 0)
    return part.withColumn("low", low).withColumn("high", high)


FACTS = "(SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN p_size - p_partkey % 3 END AS low, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN p_size + 4.0 ELSE p_size END + 1.0 END AS high FROM part)"


@query(f"SELECT p_partkey, high <= 20 AS at_most, low > 10 AS more, low >= 5 AND high <= 30 AS inside, low <= 15 AND high >= 15 AS holds FROM {FACTS}")
def interval_predicate(spark, folder):
    low, high = F.col("low"), F.col("high")
    return part_facts(spark, folder).select("p_partkey", I.satisfies(low, high, "lte", 20).alias("at_most"), I.satisfies(low, high, "gt", 10).alias("more"), I.satisfies(low, high, "between", 5, 30).alias("inside"), I.satisfies(low, high, "contains", 15).alias("holds"))


TRI = f"""
WITH f AS {FACTS}, o AS (SELECT p_brand, p_type, 'c1' AS k, high <= 40 AS t FROM f UNION ALL SELECT p_brand, p_type, 'c2', low > 2 FROM f UNION ALL SELECT p_brand, p_type, 'c3', low > 20 FROM f WHERE p_partkey % 2 = 0),
e AS (SELECT p_brand, p_type, k, CASE WHEN count(t) = 0 THEN 'unknown' WHEN bool_and(t) AND count(t) = count(*) THEN 'true' WHEN NOT bool_or(t) AND count(t) = count(*) THEN 'false' WHEN bool_or(t) AND NOT bool_and(t) THEN 'conflict' ELSE 'unknown' END AS s FROM o GROUP BY ALL),
a AS (SELECT p_brand, p_type, CASE WHEN bool_or(s = 'false') THEN 'false' WHEN bool_or(s = 'conflict') THEN 'conflict' WHEN bool_or(s = 'unknown') THEN 'unknown' ELSE 'true' END AS status FROM e WHERE k IN ('c1', 'c2') GROUP BY ALL),
b AS (SELECT p_brand, p_type, CASE WHEN bool_or(s = 'false') THEN 'false' WHEN bool_or(s = 'conflict') THEN 'conflict' WHEN bool_or(s = 'unknown') THEN 'unknown' ELSE 'true' END AS status FROM e WHERE k = 'c3' GROUP BY ALL)
SELECT p_brand, p_type, CASE WHEN bool_or(status = 'true') THEN 'true' WHEN bool_or(status = 'conflict') THEN 'conflict' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'false' END AS status FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL
"""


@query(TRI)
def tri_state_status(spark, folder):
    facts, scope = part_facts(spark, folder), ["p_brand", "p_type"]

    def outcomes(rows: DataFrame, name: str, op: str, a: float) -> DataFrame:
        return rows.select(*scope, F.lit(name).alias("k"), I.satisfies(F.col("low"), F.col("high"), op, a).alias("t"))

    first = I.clause_status(outcomes(facts, "c1", "lte", 40).union(outcomes(facts, "c2", "gt", 2)), scope, "k", "t")
    second = I.clause_status(outcomes(facts.where("p_partkey % 2 = 0"), "c3", "gt", 20), scope, "k", "t")
    return I.any_clause(first.union(second), scope)


@query("""
SELECT p_partkey, CASE WHEN u IN ('kg', 'g') THEN round(CAST(p_size AS DOUBLE) * CASE u WHEN 'kg' THEN 1.0 ELSE 0.001 END, 9) END AS converted, CASE WHEN u = 'stone' THEN 'unknown_unit' WHEN u = 'mm' THEN 'incompatible_unit' END AS unit_problem
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' WHEN 2 THEN 'mm' ELSE 'stone' END AS u FROM part)
""")
def unit_conversion(spark, folder):
    part = table(spark, folder, "part").withColumn("u", F.element_at(F.array(*map(F.lit, ["kg", "g", "mm", "stone"])), (F.col("p_partkey") % 4 + 1).cast("int")))
    out = I.convert(part, "p_size", "u", {"kg": ("mass", 1000.0), "g": ("mass", 1.0), "mm": ("length", 0.001)}, "kg")
    return out.select("p_partkey", F.round("converted", 9).alias("converted"), "unit_problem")


@query(f"SELECT f.p_partkey FROM {FACTS} f WHERE EXISTS (SELECT 1 FROM {FACTS} g WHERE g.p_name = f.p_name AND g.p_brand = f.p_brand HAVING count(DISTINCT p_partkey) > 1 AND (min(low) <> max(low) OR min(high) <> max(high)))")
def revision_disagreement(spark, folder):
    return I.revision_disagreement(part_facts(spark, folder), "p_partkey", ["p_name", "p_brand"], "low", "high").select("p_partkey")


@query("SELECT p_brand, count(*) AS n, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS kinds FROM part GROUP BY 1")
def facets(spark, folder):
    return A.facets(table(spark, folder, "part"), ["p_brand"], ["p_type"]).withColumnRenamed("p_type", "kinds")


@query("SELECT p_brand, count(*) AS n FROM (SELECT p_brand, [lower(p_type), CASE WHEN p_size > 20 THEN 'large' ELSE 'small' END] AS c, lower(p_type) AS t FROM part) WHERE c[2] = 'small' GROUP BY 1")
def applicable_facts(spark, folder):
    part = table(spark, folder, "part").withColumn("conditions", F.array(F.when(F.col("p_size") > 20, "large").otherwise("small")))
    return part.where(I.conditions_apply(F.col("conditions"), ["small", "wet"])).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)),
s AS (SELECT source, sum(CASE WHEN r <= 10 AND quality = 1 THEN 1 ELSE 0 END) / nullif(sum(quality), 0) AS recall, coalesce(1.0 / min(CASE WHEN r <= 10 AND quality = 1 THEN r END), 0) AS rr FROM r GROUP BY 1)
SELECT source, round(recall, 8) AS recall_at_10, round(rr, 8) AS reciprocal_rank FROM s
""")
def retrieval_metrics(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    out = A.retrieval_metrics(rows.withColumn("place", place), ["source"], "place", F.col("quality") == 1)
    return out.select("source", F.round("recall", 8).alias("recall_at_10"), F.round("reciprocal_rank", 8).alias("reciprocal_rank"))


@query("(SELECT text AS t FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT text FROM documents WHERE doc_id % 3 = 0)")
def evidence_difference(spark, folder):
    docs = table(spark, folder, "documents")
    return E.difference(docs.where("doc_id % 2 = 0").select(F.col("text").alias("t")), docs.where("doc_id % 3 = 0").select("text"))


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, sha256(text) AS mark FROM documents GROUP BY text")
def evidence_union(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", X.text_hash(F.col("text")).alias("mark"))
    return E.united([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")], "mark", [F.asc("doc_id")]).select("doc_id", "mark")


@query("SELECT doc_id, len(list_filter([contains(lower(text), 'license'), contains(lower(text), 'work')], lambda x: x)) = 2 AS found FROM documents")
def evidence_search(spark, folder):
    return table(spark, folder, "documents").select("doc_id", E.all_terms(F.col("text"), ["License", "work"]).alias("found"))


# Reviews: events are decisions on users; an event of a given kind undoes the one before it of its user.


def review_events(spark, folder) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, folder, "events").withColumn("prior", F.lag("event_id").over(own))
    return events.withColumn("undoes", F.when(F.col("event_id") % 5 == 0, F.col("prior")))


REVIEW_EVENTS = "(SELECT *, CASE WHEN event_id % 5 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS undoes FROM events)"


@query(f"""
WITH v AS MATERIALIZED {REVIEW_EVENTS}, s AS (SELECT * FROM v WHERE undoes IS NULL AND event_id NOT IN (SELECT undoes FROM v WHERE undoes IS NOT NULL))
SELECT user_id, arg_max(event_type, event_id) AS decision, max(event_id) AS event_id FROM s GROUP BY 1
""")
def standing_decisions(spark, folder):
    alive = W.standing(review_events(spark, folder), "event_id", "undoes")
    return W.latest_decisions(alive.withColumn("decision", F.col("event_type")), "user_id", "event_id", ["decision", "event_id"])


@query("""
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision, c_custkey % 7 = 0 AS changed FROM customer WHERE c_custkey % 3 > 0)
SELECT CASE WHEN d.c_custkey IS NULL THEN 'unreviewed' WHEN d.changed THEN 'stale' ELSE d.decision END AS review_state, count(*) AS n, round(sum(CASE WHEN d.decision = 'accept' THEN 0.0 ELSE c.c_acctbal END), 2) AS balance
FROM customer c LEFT JOIN d USING (c_custkey) GROUP BY 1
""")
def review_states(spark, folder):
    customer = table(spark, folder, "customer").withColumn("print", X.text_hash(F.col("c_name")))
    decided = customer.where("c_custkey % 3 > 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "accept").otherwise("reject").alias("decision"), F.when(F.col("c_custkey") % 7 != 0, F.col("print")).alias("reviewed_print"))
    states = W.review_states(customer, decided, "c_custkey", "print")
    cleared = W.corrected(states, decided.where("decision = 'accept'").select("c_custkey", F.lit(0.0).alias("c_acctbal")), "c_custkey", ["c_acctbal"])
    return cleared.groupBy("review_state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
SELECT l_orderkey, count(*) FILTER (s_acctbal < 0) AS lost, count(*) FILTER (s_acctbal < 0) > 0 AS stale, count(*) FILTER (s_acctbal < 0) = count(*) AS baseless
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
""")
def stale_evidence(spark, folder):
    cited = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("evidence"))
    return W.stale_by_withdrawal(cited, "l_orderkey", "evidence", table(spark, folder, "supplier").where("s_acctbal < 0"), "s_suppkey")


@query("""
WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS k, 0 AS r, c_custkey AS e FROM customer UNION ALL SELECT lower(c_mktsegment) || ' ' || c_custkey // 3, 1, c_custkey FROM customer),
g AS (SELECT k, r, min(e) AS e, count(DISTINCT e) AS n FROM k GROUP BY ALL), b AS (SELECT k, arg_min(e, r) AS e, arg_min(n, r) AS n FROM g GROUP BY 1),
q AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey * 2 AS VARCHAR) ELSE lower(c_mktsegment) || ' ' || (c_custkey + 1) // 3 END AS asked FROM customer)
SELECT c_custkey, CASE WHEN b.k IS NULL THEN 'unknown' WHEN b.n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, CASE WHEN b.n = 1 THEN b.e END AS entity_id FROM q LEFT JOIN b ON b.k = q.asked
""")
def entity_resolution(spark, folder):
    customer = table(spark, folder, "customer")
    named = customer.withColumn("names", F.array(F.expr("concat(c_mktsegment, '  ', c_custkey div 3)")))
    asked = customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, (F.col("c_custkey") * 2).cast("string")).otherwise(F.expr("concat(upper(c_mktsegment), ' ', (c_custkey + 1) div 3)")).alias("asked"))
    return E.resolved(asked, "asked", named.withColumnRenamed("c_custkey", "entity"), "entity", "names").select("c_custkey", "outcome", "entity_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'united' OR (NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = '1') AND contains(lower(n_name), '1'))")
def exact_before_substring(spark, folder):
    return E.exact_before_substring(table(spark, folder, "nation"), "n_name", "1").select("n_nationkey", "n_name")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version 3') UNION SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def cited_evidence(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    edges = docs.where("doc_id % 10 = 3").select(F.array("doc_id", F.lit(-1)).alias("evidence_ids"))
    return E.cited_evidence(docs.where(E.all_terms(F.col("text"), ["License", "version 3"])), edges, "evidence_ids", docs, "doc_id").select("doc_id")


@query(f"""
WITH v AS {VERSIONS} SELECT o_orderkey FROM v WHERE o_custkey % 10 = 1 OR before IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000)
""")
def baseline_scope(spark, folder):
    versions = order_versions(spark, folder).withColumn("supersedes", F.array_compact(F.array("before")))
    orders = table(spark, folder, "orders")
    return E.baseline_scope(versions, "o_orderkey", "o_custkey", orders.where("o_custkey % 10 = 1"), orders.where("o_totalprice > 150000"), "supersedes").select("o_orderkey")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 AND text <> text || 'x' THEN 'stale' ELSE 'present' END AS state FROM documents
""")
def vectors_in_step(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", X.text_hash(F.col("text")).alias("mark"))
    embedded = docs.where("doc_id % 5 <> 0").withColumn("mark", F.when(F.col("doc_id") % 7 == 0, F.concat("mark", F.lit("x"))).otherwise(F.col("mark")))
    return E.vectors_in_step(docs, embedded, "doc_id", "mark")


@query("""
SELECT coalesce(e.c_custkey, f.c_custkey) AS c_custkey, CASE WHEN f.c_custkey IS NULL THEN 'missed' WHEN e.c_custkey IS NULL THEN 'extra' ELSE 'hit' END AS verdict
FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) e FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) f ON e.c_custkey = f.c_custkey
""")
def evaluation_report(spark, folder):
    customer = table(spark, folder, "customer")
    return E.set_report(customer.where("c_custkey % 2 = 0"), customer.where("c_custkey % 3 = 0"), "c_custkey")


@query("""
WITH p AS (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 40 OFFSET 10) SELECT * FROM (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS page_bytes FROM p) WHERE page_bytes <= 60000
""")
def inventory_page(spark, folder):
    return E.bounded_page(table(spark, folder, "documents").select("doc_id", "n_chars"), [F.col("doc_id")], F.col("n_chars"), 40, 60_000, after=10)


@query("""
SELECT count(DISTINCT coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE ' ' END, ' '), CASE WHEN c_custkey % 3 = 1 THEN c_nationkey || '@x.org' END, c_name)) AS people FROM customer
""")
def roster_identities(spark, folder):
    rows = table(spark, folder, "customer").select("c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(" ").alias("own_id"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("c_nationkey"), F.lit("@X.org "))).otherwise("").alias("mail"))
    return E.roster(rows, "own_id", "mail", ["c_name"]).agg(F.countDistinct("identity").alias("people"))


@query("""
WITH t AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'n' || n_nationkey AS unit, n AS members FROM t UNION ALL SELECT 'r' || n_regionkey, CAST(sum(n) AS BIGINT) FROM t GROUP BY 1 UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM t
""")
def unit_members(spark, folder):
    """Members of nested units: each member counts once in every unit above its own."""
    units = table(spark, folder, "nation").selectExpr("concat('n', n_nationkey) as unit", "concat('r', n_regionkey) as above").union(table(spark, folder, "region").selectExpr("concat('r', r_regionkey)", "'all'"))
    members = table(spark, folder, "customer").selectExpr("c_custkey as member", "concat('n', c_nationkey) as unit")
    return R.unit_members(units, "unit", "above", members, "member")


__all__ = ["ORACLES", "QUERIES"]
