"""Registered queries on requests: filters, metrics, calendars, places and quality. Each has its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import aggregates as A
from tessera.operators import geo as G
from tessera.operators import predicates as P
from tessera.operators import quality as Q
from tessera.streaming import ingest as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@query("""
SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS closed_count,
       CAST(count(*) - sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS open_count, round(avg(value) FILTER (value >= 50), 6) AS mean_hours,
       round(quantile_cont(value, 0.5) FILTER (value >= 50), 6) AS median_hours, round(quantile_cont(value, 0.9) FILTER (value >= 50), 6) AS p90_hours
FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-27' GROUP BY ALL
""")
def grouped_metrics(spark, folder):
    events = table(spark, folder, "events").where(P.compile_filter({"field": "event_type", "op": "in", "value": ["click", "view", "purchase"]}) & P.half_open("ts", stamp("2024-01-03"), stamp("2024-01-27")))
    week = events.withColumn("week", day(A.bucket_start("ts", "week")))
    out = A.grouped(week, ["event_type", "week"], A.metrics(F.col("value") >= 50, F.col("value")), max_groups=10_000)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_hours", "median_hours", "p90_hours")})


@query("""
SELECT lang, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE NOT coalesce(l.quality = 1 AND d.lang = 'en', false) GROUP BY lang
""")
def two_valued_filter(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    kept = rows.where(P.compile_filter({"not": {"all": [{"field": "quality", "op": "eq", "value": 1}, {"field": "lang", "op": "eq", "value": "en"}]}}))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def in_filter(spark, folder):
    kept = table(spark, folder, "orders").where(P.compile_filter({"field": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH", "2-HIGH"]}))
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 200000 GROUP BY 1")
def range_filter(spark, folder):
    kept = table(spark, folder, "orders").where(P.compile_filter({"field": "o_totalprice", "op": "range", "value": {"gt": 50000, "lte": 200000}}))
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL GROUP BY 1")
def exists_filter(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.where(P.compile_filter({"field": "toxic", "op": "exists", "value": False})).groupBy("lang").agg(F.count(F.lit(1)).alias("unlabelled"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'F' GROUP BY 1")
def family_filter(spark, folder):
    tree = {"any": [{"field": "o_orderpriority", "op": "family", "value": "pressing"}, {"field": "o_orderstatus", "op": "eq", "value": "F"}]}
    kept = table(spark, folder, "orders").where(P.compile_filter(tree, {"pressing": ["1-URGENT", "2-HIGH"]}))
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def half_open_window(spark, folder):
    return table(spark, folder, "orders").where(P.half_open("o_orderdate", stamp("1995-01-01"), stamp("1996-01-01"))).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE (o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1994-04-01')
   OR (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01') GROUP BY 1
""")
def union_periods(spark, folder):
    periods = [(stamp("1994-01-01"), stamp("1994-04-01")), (stamp("1996-01-01"), stamp("1996-04-01"))]
    return table(spark, folder, "orders").where(P.in_periods("o_orderdate", periods)).groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _buckets(interval: str) -> None:
    def f(spark, folder):
        rows = table(spark, folder, "events").withColumn("b", A.bucket_start("ts", interval))
        return rows.groupBy(day("b").alias("bucket"), day(A.next_bucket("b", interval)).alias("next_bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

    f.__name__ = f"calendar_buckets_{interval}"
    query(f"""
SELECT strftime(date_trunc('{interval}', ts), '%Y-%m-%d') AS bucket, strftime(date_trunc('{interval}', ts) + INTERVAL 1 {interval}, '%Y-%m-%d') AS next_bucket,
       event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")(f)


for _interval in ("day", "week", "month"):
    _buckets(_interval)


@query("""
WITH o AS (SELECT event_type, date_trunc('day', ts) AS b, count(*) AS n, avg(value) AS m FROM events WHERE value >= 90 GROUP BY ALL),
s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS b)
SELECT k.event_type, strftime(s.b, '%Y-%m-%d') AS bucket, coalesce(o.n, 0) AS n, round(o.m, 6) AS mean_value
FROM (SELECT DISTINCT event_type FROM o) k CROSS JOIN s LEFT JOIN o ON o.event_type = k.event_type AND o.b = s.b
""")
def dense_calendar(spark, folder):
    rows = table(spark, folder, "events").where("value >= 90").withColumn("bucket", A.bucket_start("ts", "day").cast("timestamp_ntz"))
    observed = rows.groupBy("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    dense = A.dense_calendar(observed, "bucket", ["event_type"], "2024-01-01", "2024-02-05", "day", ["n"])
    return dense.select("event_type", day("bucket").alias("bucket"), "n", F.round("mean_value", 6).alias("mean_value"))


@query("""
WITH c AS (SELECT c_nationkey, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01') AS baseline_n,
           count(*) FILTER (o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-03-01') AS current_n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_nationkey, baseline_n, current_n, round(baseline_n / 31.0, 8) AS baseline_rate, round(current_n / 28.0, 8) AS current_rate, current_n - baseline_n AS absolute_change,
       round((current_n - baseline_n) / CAST(nullif(baseline_n, 0) AS DOUBLE), 8) AS relative_change,
       round((current_n / 28.0 - baseline_n / 31.0) / nullif(baseline_n / 31.0, 0), 8) AS rate_change FROM c WHERE baseline_n + current_n >= 2
""")
def compare_periods(spark, folder):
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = A.compare_periods(rows, ["c_nationkey"], "o_orderdate", (stamp("1995-01-01"), stamp("1995-02-01")), (stamp("1995-02-01"), stamp("1995-03-01")), (31, 28), min_count=2)
    return out.withColumns({c: F.round(c, 8) for c in ("baseline_rate", "current_rate", "relative_change", "rate_change")})


@query("""
SELECT d.source, count(*) AS n, round(avg(l.quality), 6) AS mean_quality, row_number() OVER (ORDER BY round(avg(l.quality), 6) DESC NULLS LAST, d.source) AS place
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1 ORDER BY place LIMIT 12
""")
def rank_nulls_last(spark, folder):
    from pyspark.sql import Window

    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    groups = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    top = A.ranked(groups, "mean_quality", ["source"], top=12)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_quality"), "source")).cast("long"))  # twelve rows


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 12")
def minimum_count(spark, folder):
    return A.grouped(table(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], {"n": F.count(F.lit(1))}, min_count=12)


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 5")
def top_page(spark, folder):
    groups = A.grouped(table(spark, folder, "orders"), ["o_custkey"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)})
    return A.ranked(groups, "n", ["o_custkey"], top=20, offset=5)


@query("SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS BIGINT) AS closed_count, CAST(NULL AS DOUBLE) AS mean_hours FROM orders WHERE o_totalprice < 0")
def grand_total_of_nothing(spark, folder):
    none = table(spark, folder, "orders").where("o_totalprice < 0")
    return A.grouped(none, [], A.metrics(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).select("n", "closed_count", "mean_hours")


@query("""
WITH g AS (SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY ALL ORDER BY count(*) DESC, o_orderpriority, o_orderstatus LIMIT 3)
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders SEMI JOIN g USING (o_orderpriority, o_orderstatus)
""")
def drill_through(spark, folder):
    orders, keys = table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"]
    chosen = A.ranked(A.grouped(orders, keys, {"n": F.count(F.lit(1))}), "n", keys, top=3)
    return A.drill_through(orders, chosen, keys).select("o_orderkey", *keys)


PLACES = "(40.4 + (c_custkey * 37 % 1000) / 2000.0) AS lat, (-74.3 + (c_custkey * 91 % 1000) / 1600.0) AS lon"


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Customers at places that follow from their keys."""
    return table(spark, folder, "customer").selectExpr("c_custkey", "cast(40.4 + (c_custkey * 37 % 1000) / 2000D as double) AS lat", "cast(-74.3 + (c_custkey * 91 % 1000) / 1600D as double) AS lon")


PLACE_SQL = "(SELECT c_custkey, CAST(40.4 AS DOUBLE) + (c_custkey * 37 % 1000) / CAST(2000 AS DOUBLE) AS lat, CAST(-74.3 AS DOUBLE) + (c_custkey * 91 % 1000) / CAST(1600 AS DOUBLE) AS lon FROM customer)"


@query(f"""
SELECT c_custkey, round(d, 2) AS metres FROM (SELECT c_custkey, 2 * 6371008.7714 * asin(sqrt(least(1.0, power(sin(radians(lat - 40.7) / 2), 2)
  + cos(radians(lat)) * cos(radians(40.7)) * power(sin(radians(lon + 74.0) / 2), 2)))) AS d FROM {PLACE_SQL}) WHERE d <= 8000
""")
def haversine_radius(spark, folder):
    rows = places(spark, folder).where(G.within_radius(F.col("lat"), F.col("lon"), 40.7, -74.0, 8000))
    return rows.select("c_custkey", F.round(G.haversine_m(F.col("lat"), F.col("lon"), 40.7, -74.0), 2).alias("metres"))


@query(f"SELECT c_custkey FROM {PLACE_SQL} WHERE lat >= 40.5 AND lat <= 40.6 AND lon >= -74.1 AND lon <= -73.9")
def bounding_box(spark, folder):
    return places(spark, folder).where(G.in_box(F.col("lat"), F.col("lon"), 40.5, -74.1, 40.6, -73.9)).select("c_custkey")


KITE = [(-74.2, 40.5), (-73.9, 40.45), (-73.75, 40.7), (-74.0, 40.85), (-74.2, 40.5)]
WEDGE = [(-74.0, 40.85), (-73.75, 40.7), (-73.7, 40.9), (-74.0, 40.85)]
SQUARE = [(-74.1, 40.5), (-74.0, 40.5), (-74.0, 40.6), (-74.1, 40.6)]


def inside_sql(ring: list[tuple[float, float]]) -> str:
    v = ring[:-1] if ring[0] == ring[-1] else ring
    parts, edge = [], []
    for (x1, y1), (x2, y2) in zip(v, v[1:] + v[:1], strict=True):
        edge.append(f"(abs((lon - ({x1!r})) * ({y2 - y1!r}) - (lat - ({y1!r})) * ({x2 - x1!r})) <= 1e-10 AND lon BETWEEN {min(x1, x2)!r} - 1e-10 AND {max(x1, x2)!r} + 1e-10 AND lat BETWEEN {min(y1, y2)!r} - 1e-10 AND {max(y1, y2)!r} + 1e-10)")
        if y1 != y2:
            parts.append(f"(CASE WHEN lat > {min(y1, y2)!r} AND lat <= {max(y1, y2)!r} AND lon < ({x2 - x1!r}) * (lat - ({y1!r})) / ({y2 - y1!r}) + ({x1!r}) THEN 1 ELSE 0 END)")
    return f"({' OR '.join(edge)} OR ({' + '.join(parts)}) % 2 = 1)"


@query(f"SELECT c_custkey FROM {PLACE_SQL} WHERE {inside_sql(KITE)}")
def point_in_polygon(spark, folder):
    return places(spark, folder).where(G.in_polygon(F.col("lat"), F.col("lon"), KITE)).select("c_custkey")


@query(f"""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 95 ELSE lat END AS lat, lon FROM {PLACE_SQL}),
f AS (SELECT c_custkey, lat, list_filter([CASE WHEN {inside_sql(KITE)} THEN 'kite' END, CASE WHEN {inside_sql(SQUARE)} THEN 'square' END, CASE WHEN {inside_sql(WEDGE)} THEN 'wedge' END], lambda x: x IS NOT NULL) AS found FROM p)
SELECT c_custkey, CASE WHEN lat BETWEEN -90 AND 90 AND len(found) = 1 THEN found[1] END AS area, CASE WHEN lat IS NULL THEN 'missing_geometry' WHEN NOT lat BETWEEN -90 AND 90 THEN 'invalid_geometry'
  WHEN len(found) = 0 THEN 'unmatched' WHEN len(found) = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM f
""")
def spatial_join_status(spark, folder):
    points = places(spark, folder).withColumn("lat", F.when(F.col("c_custkey") % 17 != 0, F.when(F.col("c_custkey") % 19 == 0, 95.0).otherwise(F.col("lat"))))
    return G.spatial_join(points, "c_custkey", "lat", "lon", G.area_table(spark, {"kite": KITE, "square": SQUARE, "wedge": WEDGE}))


@query("""
WITH j AS (SELECT o_orderstatus = 'F' AS closed, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT closed, h, array_to_string(list_filter([CASE WHEN NOT closed THEN 'date_without_closed' END, CASE WHEN h < 0 THEN 'negative_duration' END], lambda x: x IS NOT NULL), '|') AS flags FROM j)
SELECT flags, closed AS is_closed, count(*) AS n, round(avg(CASE WHEN closed AND h >= 0 THEN h END), 4) AS mean_hours FROM f GROUP BY ALL
""")
def closure_quality_flags(spark, folder):
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = rows.withColumn("status", F.when(F.col("o_orderstatus") == "F", " CLOSED ").otherwise("open"))
    found = Q.normalized_requests(status, "l_orderkey", "status", "o_orderdate", "l_shipdate", ["l_returnflag"])
    return found.groupBy(F.array_join("quality_flags", "|").alias("flags"), "is_closed").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("closure_hours"), 4).alias("mean_hours"))


@query(None)
def strict_local_times(spark, folder):
    """Order dates at an hour that follows from the key, as New York wall clocks: skipped and repeated times are null."""
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, cast(o_orderkey % 4 as int), 30, 0)")).alias("wall"))
    utc, n = Q.strict_utc(F.col("wall"), "America/New_York", (4, 5))
    return rows.select("o_orderkey", F.date_format(utc, "yyyy-MM-dd HH:mm").alias("utc"), n.alias("candidates"))


@query("""
WITH r AS (SELECT *, row_number() OVER w AS place, first(l_quantity) OVER w AS q1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))
SELECT CASE WHEN place = 1 THEN 'kept' WHEN l_quantity = q1 THEN 'duplicate' ELSE 'quarantined' END AS outcome, count(*) AS n FROM r GROUP BY 1
""")
def dedupe_conflict(spark, folder):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")]
    return Q.outcome_counts(Q.deduplicated(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity"], order))


@query("""
SELECT u.f AS field, u.p AS present, u.t - u.p AS missing, u.d AS distinct_values FROM (SELECT unnest([
  {'f': 'lang', 'p': count(lang), 't': count(*), 'd': count(DISTINCT lang)}, {'f': 'quality', 'p': count(quality), 't': count(*), 'd': count(DISTINCT quality)},
  {'f': 'toxic', 'p': count(toxic), 't': count(*), 'd': count(DISTINCT toxic)}]) AS u FROM documents LEFT JOIN labels USING (doc_id))
""")
def profile_coverage(spark, folder):
    return Q.profile(table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left"), ["lang", "quality", "toxic"])


@query("SELECT sha256(text) AS mark, count(DISTINCT source) AS n_values, string_agg(DISTINCT source, '|' ORDER BY source) AS vals FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def conflict_values(spark, folder):
    return Q.conflicts(table(spark, folder, "documents").withColumn("mark", X.text_hash(F.col("text"))), ["mark"], "source")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_field(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT bin, n, round(mean_probability, 8) AS mean_probability, round(hits / n, 8) AS observed,
 round((hits / n + 3.8414588206941227 / (2 * n) - 1.959963984540054 * sqrt((hits / n * (1 - hits / n) + 3.8414588206941227 / (4 * n)) / n)) / (1 + 3.8414588206941227 / n), 8) AS low,
 round((hits / n + 3.8414588206941227 / (2 * n) + 1.959963984540054 * sqrt((hits / n * (1 - hits / n) + 3.8414588206941227 / (4 * n)) / n)) / (1 + 3.8414588206941227 / n), 8) AS high,
 round(abs(mean_probability - hits / n), 8) AS gap
FROM (SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_probability, CAST(sum(quality) AS DOUBLE) AS hits
      FROM (SELECT (n_chars % 1000) / 999.0 AS p, quality FROM documents JOIN labels USING (doc_id)) GROUP BY 1)
""")
def calibration_bins(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(((F.col("n_chars") % 1000) / 999.0).alias("p"), "quality")
    out = A.calibration_bins(rows, "p", "quality")
    return out.withColumns({c: F.round(c, 8) for c in ("mean_probability", "observed", "low", "high", "gap")})


@query("""
WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)
SELECT source, doc_id, n_chars, CAST(used AS BIGINT) AS used FROM r WHERE used <= 20000
""")
def evidence_budget(spark, folder):
    return A.running_budget(table(spark, folder, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], F.col("n_chars"), 20_000)


@query("""
WITH r AS (SELECT *, first(c_mktsegment) OVER w AS best_choice, lead(c_acctbal) OVER w AS nxt, row_number() OVER w AS place FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_mktsegment)),
o AS (SELECT *, max(CASE WHEN c_mktsegment <> best_choice THEN c_acctbal END) OVER (PARTITION BY c_nationkey) AS other FROM r)
SELECT c_nationkey, best_choice, c_acctbal AS best_score, round(c_acctbal - nxt, 4) AS margin, round(c_acctbal - other, 4) AS distinct_margin FROM o WHERE place = 1
""")
def margin_selection(spark, folder):
    out = A.best_and_margin(table(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment"), ["c_nationkey"], "c_acctbal", "c_mktsegment")
    return out.withColumns({"margin": F.round("margin", 4), "distinct_margin": F.round("distinct_margin", 4)})


@query("SELECT count(*) AS n FROM lineitem l ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000) o ON l.l_orderkey = o.o_orderkey")
def foreign_key_check(spark, folder):
    return Q.orphans(table(spark, folder, "lineitem"), "l_orderkey", table(spark, folder, "orders").where("o_totalprice > 1000"), "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(ltrim(v), '^[=+@-]') OR regexp_matches(v, '^[\\t\\r\\n]') THEN concat('''', v) ELSE v END AS safe
FROM (SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN ' @' WHEN 2 THEN chr(9) WHEN 3 THEN '-' ELSE '' END, text) AS v FROM documents)
""")
def spreadsheet_escape(spark, folder):
    lead = F.element_at(F.array(*map(F.lit, ["=", " @", "\t", "-", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", X.spreadsheet_safe(F.concat(lead, F.col("text"))).alias("safe"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, folder):
    """The events as a file stream, counted in tumbling days; the last state of the counts is the result."""
    schema = table(spark, folder, "events").schema
    stream = S.file_stream(spark, f"{folder}/events.parque[t]", schema, kind="parquet")  # a pattern, so that a file and a folder both do
    counts = S.tumbling_counts(stream, "ts", ["event_type"], late="60 days")
    return S.final_state(counts).select(day("start").alias("day"), "event_type", "n")
