"""Registered queries on statements, addresses, phrases, specification lines, staging, charts and releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import comms as C
from tessera.operators import extraction as L
from tessera.operators import statements as S
from tessera.plans.knowledge import PAIRS, messages
from tessera.plans.requests import ORACLES, QUERIES, query, stamp, table

# Messages whose text follows from the customer's key: what each kind says, and what it means.

SAYINGS = [
    ("I report to {x}.", "direct_report"), ("Hello. I no longer report to {x}. Bye", "negative_report"), ("> I report to {x}.", None),
    ("She said I report to {x}.", None), ("{x} is my line manager", "direct_report"), ("For the record, I report directly to {x}; as ever.", "direct_report"),
    ('"I report to {x}."', None), ("Could you approve this?", "approval_request"), ("Fine.\n-- Original message\nI report to {x}.", None),
    ("Suppose this. I report to {x}.", None), ("I don't report to {x}", "negative_report"), ("I report to nobody.", None),
    ("I report to {x} Smith.", None), ("I report to {x}, as ever.", None), ("I report to {x} of the  Old Town Hall Desk, Level No. 2!", "direct_report"), ("Hm. {x} Smith is my manager", None),
]
SAID = "(CASE c_custkey % 16 " + " ".join(f"WHEN {i} THEN {'NULL' if k is None else repr(k)}" for i, (_, k) in enumerate(SAYINGS)) + " END)"


def sayings(spark, folder) -> DataFrame:
    """c_custkey, body, boss: a message of each customer, naming the customer boss."""
    customer = table(spark, folder, "customer")
    n = customer.count()
    boss = customer.select("c_custkey", ((F.col("c_custkey") * 5 + 1) % F.lit(n)).alias("boss"))
    named = boss.join(customer.select(F.col("c_custkey").alias("boss"), F.col("c_name").alias("x")), "boss")
    forms = F.array(*[F.lit(f) for f, _ in SAYINGS])
    return named.select("c_custkey", "boss", F.replace(F.get(forms, (F.col("c_custkey") % len(SAYINGS)).cast("int")), F.lit("{x}"), F.col("x")).alias("body"))


@query(f"""
SELECT c_custkey, kind, CASE WHEN kind <> 'approval_request' THEN (c_custkey * 5 + 1) % n END AS target FROM (SELECT c_custkey, {SAID} AS kind, (SELECT count(*) FROM customer) AS n FROM customer) WHERE kind IS NOT NULL
""")
def report_statements(spark, folder):
    """Everyone has a name and a longer one; a name that goes on otherwise is nobody's."""
    names = F.explode(F.array(F.col("c_name"), F.concat("c_name", F.lit(" of the Old Town Hall Desk, Level No. 2")))).alias("c_name")
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("person"), names)
    return S.statements(sayings(spark, folder), "c_custkey", "body", people, "c_name", "person").select("c_custkey", "kind", F.col("target").cast("long").alias("target"))


@query(f"""
WITH p AS {PAIRS}, t AS (SELECT a, sum(sent) AS out FROM p GROUP BY 1), nb AS (SELECT a, b, sum(s) AS traffic FROM (SELECT a, b, sent AS s FROM p UNION ALL SELECT b, a, sent FROM p) GROUP BY ALL),
busy AS (SELECT a AS person, b AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY traffic DESC, b) AS r FROM nb) WHERE r <= 8),
said AS (SELECT n_nationkey AS person, (n_nationkey * 7 + 3) % 25 AS candidate, CASE WHEN n_nationkey % 3 = 0 THEN 1 + n_nationkey % 4 ELSE 0 END AS st, CASE WHEN n_nationkey % 6 = 3 THEN 1 ELSE 0 END AS dn FROM nation WHERE n_nationkey % 3 = 0 AND (n_nationkey * 7 + 3) % 25 <> n_nationkey),
c AS (SELECT person, candidate FROM busy UNION SELECT person, candidate FROM said),
f AS (SELECT c.person, c.candidate, coalesce(x.sent, 0) AS fwd, coalesce(y.sent, 0) AS rev, coalesce(t.out, 0) AS tot, coalesce(st, 0) AS st, coalesce(dn, 0) AS dn
 FROM c LEFT JOIN p x ON x.a = c.person AND x.b = c.candidate LEFT JOIN p y ON y.b = c.person AND y.a = c.candidate LEFT JOIN t ON t.a = c.person LEFT JOIN said s ON s.person = c.person AND s.candidate = c.candidate),
g AS (SELECT *, CASE WHEN fwd + rev > 0 THEN least(0.52, 0.08 + 0.20 * fwd / greatest(tot, 1) + 0.14 * least(fwd, rev) / greatest(fwd, rev, 1) + 0.10 * least(1.0, ln(1 + fwd + rev) / ln(11.0))) ELSE 0 END AS behaviour FROM f),
h AS (SELECT person, candidate, dn, CASE WHEN dn > 0 THEN least(0.30, v) ELSE v END AS score FROM (SELECT *, CASE WHEN st > 0 THEN least(0.96, 0.88 + 0.02 * least(2, st - 1) + 0.04 * least(1.0, (fwd + rev) / 4.0)) ELSE behaviour END AS v FROM g)),
r AS (SELECT *, row_number() OVER w AS place, score - coalesce(lead(score) OVER w, 0) AS gap FROM h WINDOW w AS (PARTITION BY person ORDER BY score DESC, candidate)),
b AS (SELECT person, candidate, CASE WHEN dn > 0 THEN 'conflicting_evidence' WHEN score < 0.55 THEN 'weak_evidence' WHEN gap + 1e-12 < 0.08 THEN 'close_alternatives' ELSE 'threshold_and_margin_met' END AS reason FROM r WHERE place = 1)
SELECT CAST(n_nationkey AS BIGINT) AS person, CAST(CASE WHEN reason = 'threshold_and_margin_met' THEN candidate END AS BIGINT) AS manager, coalesce(reason, 'empty_candidate_set') AS reason FROM nation LEFT JOIN b ON b.person = n_nationkey
""")
def manager_selection(spark, folder):
    """Nations as people: line items are their messages, statements follow from their keys."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("person"))
    pairs = C.directed_pairs(messages(spark, folder).select(F.col("sender").cast("long").alias("sender"), F.col("recipient").cast("long").alias("recipient")), "sender", "recipient")
    stated = nation.where("person % 3 = 0").selectExpr("person", "(person * 7 + 3) % 25 as candidate", "1 + person % 4 as statements", "cast(person % 6 = 3 as long) as denials").where("person <> candidate")
    return S.selected_managers(nation, S.manager_candidates(pairs, stated))


@query(f"""
WITH p AS (SELECT l_orderkey AS m, c_nationkey AS s, s_nationkey AS r, a.n_regionkey AS su, b.n_regionkey AS ru FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS (SELECT m, s AS person, r AS other, true AS o, su, ru FROM p UNION ALL SELECT m, r, s, false, su, ru FROM p)
SELECT CAST(person AS BIGINT) AS person, count(DISTINCT other) AS breadth, count(DISTINCT CASE WHEN o THEN m END) AS sent, count(DISTINCT CASE WHEN NOT o THEN m END) AS received,
 CAST(sum(CASE WHEN su <> 4 AND ru <> 4 AND su <> ru THEN 1 ELSE 0 END) AS BIGINT) AS cross_unit, CAST(sum(CASE WHEN su <> 4 AND ru <> 4 THEN 1 ELSE 0 END) AS BIGINT) AS cross_unit_eligible FROM e GROUP BY 1
""")
def traffic_by_unit(spark, folder):
    """An order is a message from its customer's nation to those of its suppliers; regions are units, one is unknown."""
    items = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    to = items.groupBy("l_orderkey").agg(F.collect_set(F.col("s_nationkey").cast("long")).alias("to"))
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sent = to.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("c_nationkey").cast("long").alias("from"), "to")
    units = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("person"), F.when(F.col("n_regionkey") != 4, F.col("n_regionkey")).alias("unit"))
    return S.traffic_metrics(sent, "l_orderkey", "from", "to", units, "person", "unit")


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate - INTERVAL 2 HOUR WHEN 1 THEN o_orderdate + INTERVAL 5 HOUR WHEN 2 THEN o_orderdate END AS moment,
 CASE WHEN o_orderkey % 5 IN (0, 1) THEN strftime(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate - INTERVAL 2 HOUR ELSE o_orderdate + INTERVAL 5 HOUR END, '%Y-%m-%dT%H:%M:%S.000000Z') END AS utc,
 CASE o_orderkey % 5 WHEN 2 THEN 'timezone_unknown' WHEN 3 THEN 'invalid_timestamp' WHEN 4 THEN 'missing_timestamp' END AS flag FROM orders
""")
def message_times(spark, folder):
    """Order dates as headers state them: ISO with a zone, RFC 2822, without a zone, broken, empty."""
    orders = table(spark, folder, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp_ntz"))
    stated = [F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), F.date_format("d", "EEE, d MMM yyyy HH:mm:ss' -0500'"), F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("d", "'around' yyyy"), F.lit(" ")]
    moment, flag = S.message_time(F.get(F.array(*stated), (F.col("o_orderkey") % 5).cast("int")))
    rows = orders.select("o_orderkey", moment.alias("moment"), flag.alias("flag"))
    return rows.select("o_orderkey", "moment", F.when(F.col("flag").isNull(), S.canonical_utc(F.col("moment"))).alias("utc"), "flag")


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@x.org,' || CASE WHEN c_custkey % 2 = 0 THEN 'b' || c_nationkey || '@y.net' ELSE 'all@z.com' END AS mails FROM customer")
def mail_addresses(spark, folder):
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("B"), F.col("c_nationkey"), F.lit("@Y.net"))).otherwise("<mailto:ALL@z.com>")
    header = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit(' Desk" <'), name, F.lit("@X.org>; nobody; "), second)
    return table(spark, folder, "customer").select("c_custkey", F.array_join(S.addresses(header), ",").alias("mails"))


# Phrases and specification lines that follow from a part.

PHRASES = {"large bolt": "fastener_large", "bolt": "fastener", "small widget": "part_small", "cold": "temperature", "large": "size"}


@query("SELECT p_partkey, lower(p_name) || '-' || p_partkey AS folded FROM part")
def folded_names(spark, folder):
    wide = F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９")
    return table(spark, folder, "part").select("p_partkey", L.folded(F.concat(F.lit(" "), F.upper("p_name"), F.lit("–"), wide)).alias("folded"))


@query("""
SELECT name, count(*) AS n, min(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\bsmall\\s+widget\\b', 'part_small', 'g'), '\\blarge\\s+bolt\\b', 'fastener_large', 'g'), '\\blarge\\b', 'size', 'g'), '\\bbolt\\b', 'fastener', 'g'), '\\bcold\\b', 'temperature', 'g')) AS concepts
FROM (SELECT replace(p_name, ' ', repeat(' ', CAST(p_partkey % 3 + 1 AS INTEGER))) AS name FROM part) GROUP BY 1
""")
def ontology_terms(spark, folder):
    """Names with one to three blanks between their words."""
    name = F.replace("p_name", F.lit(" "), F.repeat(F.lit(" "), (F.col("p_partkey") % 3 + 1).cast("int")))
    names = table(spark, folder, "part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.select("name", "n", L.with_concepts(F.col("name"), PHRASES).alias("concepts"))


UNITS = {"kg": ("kg", 1.0), "g": ("kg", 0.001), "ml": ("cm3", 1.0), "l": ("L", 1.0), "mm": ("mm", 1.0), "rpm": ("rpm", 1.0)}
ATTRIBUTES = {"weight": "kg", "displacement": "cm3", "capacity": "L", "length": "mm", "width": "mm"}


@query("""
SELECT p_partkey, CASE u WHEN 'kg' THEN 'weight' WHEN 'g' THEN 'weight' WHEN 'ml' THEN 'displacement' WHEN 'l' THEN 'capacity' WHEN 'mm' THEN 'length,width' ELSE '' END AS attributes,
 CASE u WHEN 'ml' THEN round(p_size / 1000.0, 9) WHEN 'l' THEN CAST(p_size AS DOUBLE) END AS litres FROM (SELECT *, (['kg', 'g', 'ml', 'l', 'mm', 'stone'])[p_partkey % 6 + 1] AS u FROM part)
""")
def unit_attributes(spark, folder):
    part = table(spark, folder, "part").withColumn("u", F.get(F.array(*map(F.lit, ["kg", "g", "ml", "l", "mm", "stone"])), (F.col("p_partkey") % 6).cast("int")))
    litres = L.unit_value(F.col("p_size").cast("double"), F.col("u"), UNITS, "L", {("cm3", "L"): 0.001, ("L", "cm3"): 1000.0})
    return part.select("p_partkey", F.array_join(L.attributes_of_unit(F.col("u"), UNITS, ATTRIBUTES), ",").alias("attributes"), F.round(litres, 9).alias("litres"))


@query("""
WITH p AS (SELECT *, p_partkey % 12 AS k, CAST(p_size AS DOUBLE) AS s FROM part),
v(k, n, attribute, f, g, h, m, unit) AS (VALUES (0, 1, 'weight', 1.0, NULL, NULL, NULL, 'kg'), (1, 1, 'weight', 0.001, NULL, NULL, 0.002, 'kg'), (2, 1, 'weight', 1.0, 4.0, NULL, NULL, 'kg'), (3, 1, 'weight', 1.0, NULL, NULL, 0.05, 'kg'),
 (6, 1, 'weight', 1.0, NULL, NULL, NULL, 'kg'), (6, 2, 'weight', 0.001, NULL, NULL, NULL, 'kg'), (7, 1, 'weight', 1.0, NULL, NULL, NULL, 'kg'), (7, 2, 'weight', 1.0, NULL, NULL, NULL, 'kg'), (8, 1, 'capacity', 1.0, NULL, 4.0, NULL, 'L'),
 (9, 1, 'weight', 0.001, NULL, NULL, NULL, 'kg'), (10, 1, 'speed', 1.0, NULL, NULL, NULL, 'rpm'), (10, 2, 'weight', 1.0, NULL, NULL, NULL, 'kg'), (10, 3, 'weight', 1.0, NULL, NULL, NULL, 'kg')),
x AS (SELECT p_partkey, p.k, n, attribute, unit, (CASE WHEN p.k = 3 THEN 1000.0 + s WHEN n > 1 THEN s + n - 1 ELSE s END) * f AS value, s + g AS value_max, s + h AS also, CASE WHEN p.k = 3 THEN (1000.0 + s) * m ELSE m END AS minus FROM p JOIN v ON v.k = p.k)
SELECT p_partkey, attribute, CAST(n AS INTEGER) AS number, round(value, 9) AS value, value_max, also, round(minus, 9) AS minus, unit, CASE k WHEN 0 THEN 'rated' WHEN 1 THEN 'no_load' WHEN 2 THEN 'peak' ELSE 'unspecified' END AS qualifier,
 CASE k WHEN 0 THEN 'net weight|with oil' WHEN 2 THEN 'at 2 bar' WHEN 3 THEN 'Dry weight|approximate value; tolerance unspecified' WHEN 7 THEN 'shipping weight|less oil and water' WHEN 8 THEN 'Fuel capacity|3-phase|80% power factor' WHEN 10 THEN 'when hot|governed speed' ELSE '' END AS conditions FROM x
""")
def line_values(spark, folder):
    """Lines stating weights and more: plain, with a tolerance, as a range, in per cent, with an unknown unit, after `at`,
    several of one label, of several labels, dual ratings, units in brackets, and units of another quantity."""
    forms = [
        "Rated net weight: {s} kg with oil.", "Idle weight {s} ± 2 g", "Weight, peak {s} to {t} kg at 2 bar;", "Dry weight approx. 1,{s} +/- 5% kg", "Weight {s} stone", "Weight at {s} kg",
        "Weight: {s} kg, {u} g", "Weight {s} kg / shipping weight {u} kg less oil and water plus 5 parts", "Fuel capacity {s}/{t} l, 3-phase, 80% power factor", "Weight (g): {s}, {s} mm", "Governed speed {s} rpm; weight {u} kg, {w}kg when hot", "Weight {t} - 0 kg, 5 kg to 6 mm",
    ]
    size = F.when(F.col("p_partkey") % 12 == 3, F.lpad(F.col("p_size").cast("string"), 3, "0")).otherwise(F.col("p_size").cast("string"))
    line = F.replace(F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 12).cast("int")), F.lit("{s}"), size)
    for mark, more in (("{t}", 4), ("{u}", 1), ("{w}", 2)):
        line = F.replace(line, F.lit(mark), (F.col("p_size") + more).cast("string"))
    labels = {"weight": r"\bweight\b", "capacity": r"\bcapacity\b", "speed": r"\bspeed\b"}
    found = L.line_values(table(spark, folder, "part").select("p_partkey", line.alias("line")), "line", labels, UNITS, {"weight": "kg", "capacity": "L", "speed": "rpm"})
    number = F.row_number().over(Window.partitionBy("p_partkey").orderBy("label_no", "value_no"))
    return found.select("p_partkey", "attribute", number.alias("number"), F.round("value", 9).alias("value"), "value_max", "also", F.round("minus", 9).alias("minus"), "unit", L.qualifier(F.col("line")).alias("qualifier"), F.array_join(L.conditions(F.col("line"), F.col("line")), "|").alias("conditions"))


@query("""
WITH f AS (SELECT p_partkey AS fact, p_brand AS model, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS variant FROM part WHERE p_name LIKE 'large %')
SELECT v.p_brand, v.p_type, count(fact) AS facts FROM (SELECT DISTINCT p_brand, p_type FROM part) v JOIN f ON f.model = v.p_brand AND (f.variant IS NULL OR f.variant = v.p_type) GROUP BY ALL
""")
def variant_facts(spark, folder):
    """Facts of large parts: two thirds hold for one type of a brand, the others for every type."""
    part = table(spark, folder, "part").withColumn("size_word", F.concat(F.lit(" "), F.element_at(F.split("p_name", " "), 1)))
    facts = L.in_scope(part, {"size_word": " LARGE"}).select("p_brand", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_type"), F.col("p_partkey").alias("fact"))
    found = L.facts_of_variants(part.select("p_brand", "p_type").distinct(), facts, "p_brand", "p_type")
    return found.groupBy("p_brand", found["p_type"]).agg(F.count("fact").alias("facts"))


__all__ = ["ORACLES", "QUERIES"]
