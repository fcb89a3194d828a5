"""Operators against small brute-force versions and by property."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import aggregates as A
from tessera.operators import geo as G
from tessera.operators import graph as R
from tessera.operators import intervals as I
from tessera.operators import predicates as P
from tessera.operators import quality as Q
from tessera.operators import temporal as TT
from tessera import session
from tessera.sources import geojson, readers, sinks
from tessera.streaming import ingest


def test_negation_keeps_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, x string")
    tree = {"not": {"field": "x", "op": "eq", "value": "a"}}
    assert [r.i for r in df.where(P.compile_filter(tree)).collect()] == [2, 3]
    assert df.where(P.compile_filter({"all": []})).count() == df.where(P.compile_filter({"any": []})).count() == 3


@pytest.mark.parametrize("tree", [{"field": "x", "op": "in", "value": []}, {"field": "x", "op": "range", "value": {"gt": 1, "gte": 2}}, {"field": "x", "op": "like", "value": "a"}, {"field": "x", "op": "family", "value": "?"}, {"field": "x", "op": "range", "value": {"gt": float("nan")}}])
def test_bad_filters_are_errors(spark, tree):
    with pytest.raises(P.RequestError):
        P.compile_filter(tree, {})


def test_budgets_fail_instead_of_cutting(spark):
    assert P.bounded(spark.range(5), 5).count() == 5
    with pytest.raises(P.RequestError):
        P.bounded(spark.range(6), 5)
    with pytest.raises(P.RequestError):
        P.require_coverage({"complete": True, "gte": "2024", "lt": "2025"}, "2023", "2024")


def test_last_month_is_local():
    start, end = P.last_month(datetime(2025, 4, 1, 2, tzinfo=timezone.utc), "America/New_York")
    assert (start.isoformat(), end.isoformat()) == ("2025-02-01T05:00:00+00:00", "2025-03-01T05:00:00+00:00")


def test_clock_changes(spark):
    rows = [("2025-03-09 02:30:00", None, 0), ("2025-11-02 01:30:00", None, 2), ("2025-07-01 12:00:00", "2025-07-01 16:00:00", 1), ("2025-01-01 12:00:00", "2025-01-01 17:00:00", 1)]
    df = spark.createDataFrame([(r[0],) for r in rows], "wall string").withColumn("wall", F.col("wall").cast("timestamp_ntz"))
    utc, n = Q.strict_utc(F.col("wall"), "America/New_York", (4, 5))
    got = df.select(F.col("wall").cast("string").alias("w"), utc.cast("string").alias("u"), n.alias("n")).collect()
    assert [tuple(r) for r in got] == rows


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "closed boolean, h double")
    row = A.grouped(df, [], A.metrics(F.col("closed"), F.col("h"))).first()
    assert (row.n, row.closed_count, row.open_count, row.mean_hours, row.p90_hours) == (0, 0, 0, None, None)


def test_open_counts_rows_of_unknown_state(spark):
    df = spark.createDataFrame([(True, 1.0), (True, None), (None, 5.0), (True, -2.0), (True, float("nan"))], "closed boolean, h double")
    row = A.grouped(df, [], A.metrics(F.col("closed"), F.col("h"))).first()
    assert (row.n, row.closed_count, row.open_count, row.mean_hours) == (5, 4, 1, 1.0)


def test_polygon(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    points = [(1.0, 1.0, True), (0.0, 2.0, True), (4.0, 4.0, True), (5.0, 1.0, False), (2.0, -0.1, False), (None, 1.0, False)]
    df = spark.createDataFrame([p[:2] for p in points], "lat double, lon double")
    assert [r[0] for r in df.select(G.in_polygon(F.col("lat"), F.col("lon"), square)).collect()] == [p[2] for p in points]
    date_line = [(179.0, 0.0), (-179.0, 0.0), (-179.0, 2.0), (179.0, 2.0)]
    df = spark.createDataFrame([(1.0, 179.5), (1.0, -179.5), (1.0, 0.0)], "lat double, lon double")
    assert [r[0] for r in df.select(G.in_polygon(F.col("lat"), F.col("lon"), date_line)).collect()] == [True, True, False]
    assert G.polygon_problem(square) is None
    assert G.polygon_problem([(0, 0), (2, 2), (2, 0), (0, 2)]) == "self_intersection"
    assert G.polygon_problem([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]) == "self_intersection"  # touches
    assert G.polygon_problem([(0, 0), (4, 0), (4, 2), (4, 0), (0, 4)]) == "repeated_points"
    assert G.polygon_problem([(0, 0), (1, 1)]) == "too_few_points"
    assert G.polygon_problem([(0, 0), (1, 1), (2, 2)]) == "no_area"


def test_disputes_equal_the_pairwise_rule(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(3), rng.randrange(30), None if rng.random() < 0.1 else rng.randrange(32)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, g int, c int, b int, e int").selectExpr("i", "g", "c", "date_add(date'2020-01-01', b) as b", "date_add(date'2020-01-01', e) as e")
    got = {r.i: r.disputed for r in TT.disputed(df, "g", "i", "c", "b", "e").collect()}
    real = [(i, g, c, b, 10**6 if e is None else e) for i, g, c, b, e in rows if e is None or b < e]
    assert got == {i: any(g == h and c != d and max(b, p) < min(e, q) for _, h, d, p, q in real) for i, g, c, b, e in real}


def greedy_forest(edges):
    """Edges by (priority, -score, child); one that would join connected nodes is rejected."""
    root, status = {}, {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for child, parent, _, _ in sorted(edges, key=lambda e: (e[2], -e[3], e[0])):
        a, b = find(child), find(parent)
        status[child] = "cycle_conflict" if a == b else "selected"
        if a != b:
            root[a] = b
    return status


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    edges = [(i, rng.choice([j for j in range(40) if j != i]), rng.randrange(3), float(rng.randrange(5))) for i in range(40)]
    got = {r.child: r.status for r in R.forest(spark.createDataFrame(edges, "child int, parent int, priority int, score double"), "child", "parent", "priority", "score").collect()}
    assert got == greedy_forest(edges)


def test_chain_problems(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 99), (6, None), (7, 6)], "v long, p long")
    assert {(r.v, r.problem) for r in TT.chain_problems(df, "v", "p").collect()} == {(1, "cycle"), (2, "cycle"), (3, "cycle"), (5, "missing_parent")}


def test_bfs_and_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "src int, dst int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.hop) for r in R.reachable(df, seeds, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert R.edges_from(df, R.reachable(df, seeds, 2), 2).count() == 2
    assert {(r.node, r.component) for r in R.components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_subtrees_of_a_deep_chain(spark):
    links = [(0, None, 1)] + [(i, i - 1, i % 2) for i in range(1, 1000)] + [(2000, 50, 1), (3000, None, 0)]
    tree = spark.createDataFrame(links, "c int, p int, u int")
    got = {r.node: (r.subtree, r.depth, r.u) for r in R.subtree_sizes(tree, "c", "p", ("u",)).collect()}
    assert got == {i: (1000 - i + (i <= 50), 999 - i, sum(k % 2 for k in range(i, 1000)) + (i == 0) + (i <= 50)) for i in range(1000)} | {2000: (1, 0, 1), 3000: (1, 0, 0)}
    with pytest.raises(ValueError, match="cycle"):
        R.subtree_sizes(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c int, p int"), "c", "p")


def test_units_of_any_depth_and_without_cycles(spark):
    units = spark.createDataFrame([(i, i + 1 if i < 99 else None) for i in range(100)], "unit int, above int")
    members = spark.createDataFrame([("a", 0), ("b", 60), ("a", 60)], "member string, unit int")
    got = {r.unit: r.members for r in R.unit_members(units, "unit", "above", members, "member").collect()}
    assert got == {i: 0 if i < 0 else 1 if i < 60 else 2 for i in range(100)}
    assert R.ancestors(units, "unit", "above", most=3).where("node = 0").count() == 3
    links = [(1, 4), (2, 3), (3, 4), (4, 2), (5, 5), (6, 99), (7, 6), (8, 9), (9, 8)]
    got = {r.unit: r.above for r in R.without_unit_cycles(spark.createDataFrame(links, "unit int, above int"), "unit", "above").collect()}
    assert got == {1: 4, 2: 3, 3: 4, 4: None, 5: None, 6: None, 7: 6, 8: None, 9: 8}


def test_bounded_view_and_chart(spark):
    people = [(1, None, "Ann", 0), (2, 1, "bob", 1), (3, 1, "Cid", 0), (4, 2, "dan", 1), (5, 3, "Eve", 0), (6, None, "fay", 0)]
    tree = spark.createDataFrame(people, "c int, p int, name string, open int")
    assert [r.node for r in R.bounded_view(tree, "c", "p", "name", 2, limit=4).orderBy("position").collect()] == [2, 1, 4, 3]
    top = R.branch_chart(tree, "c", "p", "name", "open", detail=3).collect()
    assert [(r.node, r.kind, r.person_count, r.unresolved_count) for r in top] == [(1, "branch", 5, 2), (6, "person", None, None)]
    assert [r.node for r in R.branch_chart(tree, "c", "p", "name", "open").collect()] == [1, 2, 3, 4, 5, 6]


def test_expansion_reports_what_it_leaves_out(spark):
    edges = spark.createDataFrame([(i, "hub", f"n{i}") for i in range(6)] + [(10, "n0", "far"), (11, "far", "farther")], "e int, a string, b string")
    seed = spark.createDataFrame([(0, 1.0)], "e int, score double")

    def run(**most):
        found, reasons = R.expanded(edges, "e", "a", "b", seed, **most)
        return {(r.e, r.hop) for r in found.collect()}, reasons

    assert run() == ({(0, 0), *((i, 1) for i in range(1, 6)), (10, 1), (11, 2)}, set())
    assert run(hops=1, per_node=2) == ({(0, 0), (1, 1), (10, 1)}, {"per_node_budget"})
    assert run(most_edges=3) == ({(0, 0), (1, 1), (2, 1)}, {"visit_budget"})
    assert run(most_edges=0) == (set(), {"edge_budget"})


def test_calibration_fit_equals_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(x := rng.random(), int(rng.random() < 1 / (1 + 2.718281828 ** (2 - 5 * x)))) for _ in range(300)]
    slope, intercept = A.calibrator(spark.createDataFrame(rows, "s double, y int"), "s", "y")

    def gradient(a, b):
        errors = [(1 / (1 + 2.718281828459045 ** -(a * x + b)) - y, x) for x, y in rows]
        return sum(e * x for e, x in errors) + a, sum(e for e, _ in errors)

    assert max(map(abs, gradient(slope, intercept))) < 1e-6 and 1 < slope < 6

def test_day_eligibility(spark):
    df = spark.sql("select * from values (1, null, null), (2, date'2020-01-01', null), (3, null, date'2020-01-05'), (4, date'2020-01-01', date'2020-01-05') as t(i, b, e)")
    day = datetime(2020, 1, 5).date()
    assert [r.i for r in df.where(TT.eligible_on(F.col("b"), F.col("e"), day)).collect()] == [2]
    assert df.where(TT.eligible_on(F.col("b"), F.col("e"), None)).count() == 4


def test_intervals(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, None)], "low double, high double")
    got = df.select(*[I.satisfies(F.col("low"), F.col("high"), op, a, b).alias(op) for op, a, b in (("lte", 2, None), ("lt", 2, None), ("between", 1, 2), ("contains", 1.5, None))]).collect()
    assert got == [Row(lte=True, lt=False, between=True, contains=True), Row(lte=None, lt=None, between=None, contains=None)]
    facts = spark.createDataFrame([("a", "k", True), ("a", "k", True), ("b", "k", True), ("b", "k", False), ("c", "k", None), ("d", "k", False), ("d", "m", None)], "s string, k string, t boolean")
    assert {r.s: r.status for r in I.clause_status(facts, ["s"], "k", "t").collect()} == {"a": "true", "b": "conflict", "c": "unknown", "d": "false"}


def test_text_functions(spark):
    df = spark.createDataFrame([("=1", " 1,234.5 "), ("a=1", "1.234,5"), ("\tx", "3 1/2"), (None, "n/a")], "v string, n string")
    got = df.select(X.spreadsheet_safe(F.col("v")).alias("v"), X.number_value(F.col("n")).alias("n")).collect()
    assert got == [Row(v="'=1", n=1234.5), Row(v="a=1", n=1234.5), Row(v="'\tx", n=3.5), Row(v=None, n=None)]
    page = spark.createDataFrame([("<p>a &lt; b<script>x<y</script><br/>c",)], "h string")
    assert page.select(X.html_text(F.col("h"))).first()[0] == "a < b c"


def test_bad_vectors_have_no_direction(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.normalized(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None]


def test_quality_flags(spark):
    df = spark.sql("select * from values (1, 'Closed', timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-01', ' ', '95', '1'), (2, 'closed ', timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02', 'x', '40', '-74'), (3, 'Open', null, null, 'y', null, '1') as t(k, s, c, d, a, lat, lon)")
    got = {r.k: r for r in Q.normalized_requests(df, "k", "s", "c", "d", ["a"], "lat", "lon").collect()}
    assert got[1].quality_flags == ["invalid_location", "missing_a", "negative_duration"] and got[1].closure_hours is None
    assert got[2].quality_flags == [] and got[2].closure_hours == 24.0 and got[2].location.lat == 40.0
    assert got[3].quality_flags == ["missing_created_date", "missing_location"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1, "x": "a"}\nbroken\n{"i": 2, "x": null}\n')
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("x", T.StringType())])
    good, bad = readers.json_lines_with_rejects(spark, str(tmp_path / "a.jsonl"), schema)
    assert good.count() == 2 and [r.value for r in bad.collect()] == ["broken"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()
    (tmp_path / "m.csv").write_text('Message ID,From,Extra\n1,"a ""b""",z\n')
    assert readers.csv_table(spark, str(tmp_path / "m.csv"), {"id": ["message id"], "sender": ["from"], "cc": []}, ["id"]).collect() == [Row(id="1", sender='a "b"', cc=None)]
    with pytest.raises(ValueError):
        readers.csv_table(spark, str(tmp_path / "m.csv"), {"to": []}, ["to"])
    (tmp_path / "x.eml").write_text("From: A <A@x.org>\nTo: b@x.org, C <c@x.org>\nSubject: hi\nMessage-ID: <1>\n\nhello\n")
    mail = readers.mail_files(spark, str(tmp_path / "x.eml")).first()
    assert (mail.sender, mail.recipients, mail.body.strip()) == ("a@x.org", ["b@x.org", "c@x.org"], "hello")
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"code": "q"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    area = geojson.geojson_features(spark, str(tmp_path / "g.json"), ["code"]).first()
    assert (area.code, area.rings[0][1]) == ("q", [1.0, 0.0])
    df = spark.createDataFrame([("=1", 1), ("b", 2)], "t string, n int")
    assert sinks.export_csv(df, str(tmp_path / "out"), 2, one_file=True) == 2
    with pytest.raises(P.RequestError, match="10 bytes"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema, max_line_bytes=10)
    assert "'=1,1" in next((tmp_path / "out").glob("part-*")).read_text()
    with pytest.raises(P.RequestError):
        sinks.export_csv(df, str(tmp_path / "out2"), 1)
    assert not (tmp_path / "out2").exists()
    sinks.publish_snapshot(df, str(tmp_path / "s"), 1)
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), 1).count() == 2
    assert readers.generated_requests(spark, 500).where("closure_hours < 0").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: settings.get(key, default))
            set = staticmethod(lambda key, value: settings.__setitem__(key, value))

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: given)

    settings, given = {}, None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)
    given = "hdfs://shared/own"
    assert session.shared_folder(Session) == given
    settings["spark.checkpoint.dir"] = "hdfs://shared/set"
    assert session.shared_folder(Session) == "hdfs://shared/set"
    settings.clear()
    given, Session.sparkContext.master = None, "local[2]"
    assert session.shared_folder(Session) == settings["spark.checkpoint.dir"]


def test_replayed_ingest_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])

    def run(checkpoint):
        ingest.ingest_once(ingest.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1), str(tmp_path / "out"), str(tmp_path / checkpoint), "k", "v").awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in/1.json").write_text('{"k": "a", "v": 2}\n{"k": "a", "v": 1}\n')
    assert run("c1") == [("a", 1)]
    (tmp_path / "in/2.json").write_text('{"k": "a", "v": 0}\n{"k": "b", "v": 5}\n')
    assert run("c1") == [("a", 1), ("b", 5)]
    assert run("c2") == [("a", 1), ("b", 5)]  # as if the checkpoint were lost


# Places and pages


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_of_three_million_rows(spark, adaptive):
    """Several ranges, ties broken by the key, with adaptive execution on and off."""
    from tessera.operators import staging

    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(0, 3_000_000, 1, 8).select("id", F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("x"))
        found = session.settled(staging.numbered_pages(rows, [F.desc("x"), F.asc("id")], 1000), "places")
        facts = found.agg(F.count_distinct("place").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.max("page").alias("page")).first()
        assert tuple(facts) == (3_000_000, 0, 2_999_999, 2999)
        assert len({f for f in found.select(F.input_file_name()).distinct().collect()}) > 1
        # neighbours by place are in order
        a, b = found.select("place", "x", "id"), found.select((F.col("place") - 1).alias("place"), F.col("x").alias("y"), F.col("id").alias("j"))
        assert a.join(b, "place").where("y > x or (y = x and j < id)").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def plain_pages(sizes, max_items, max_bytes):
    pages, items, used = [], 0, 0
    for i, s in enumerate(sizes):
        if i == 0 or items == max_items or used + s > max_bytes:
            pages.append(i)
            items, used = 0, 0
        items, used = items + 1, used + s
    return pages


@pytest.mark.parametrize(("n", "max_items", "max_bytes", "segment"), [(1_000_000, 100, 4000, 1 << 17), (5_000, 7, 60, 3), (5_000, 40, 10_000, 64), (300, 50, 50, 20), (1, 5, 100, 10), (0, 5, 100, 10)])
def test_byte_pages_equal_a_plain_loop(spark, n, max_items, max_bytes, segment):
    from tessera.operators import staging

    rows = spark.range(0, n, 1, 6).select("id", F.pmod(F.xxhash64("id"), F.lit(51)).alias("bytes"), F.lit(1).alias("place_of"))
    got = staging.byte_pages(rows, [F.desc("id")], F.col("bytes"), max_items, max_bytes, segment)
    found = got.groupBy("page").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"), F.max("id").alias("first")).orderBy("page").collect()
    sizes = [r.bytes for r in rows.orderBy(F.desc("id")).collect()]
    want = plain_pages(sizes, max_items, max_bytes)
    assert [r.start for r in found] == want and [r.page for r in found] == list(range(len(want))) and sum(r.n for r in found) == n
    assert [r["first"] for r in found] == [n - 1 - s for s in want]


def test_an_item_larger_than_a_page_is_an_error(spark):
    from tessera.operators import staging

    with pytest.raises(P.RequestError):
        staging.byte_pages(spark.range(9), [F.asc("id")], F.col("id"), 5, 7)


# Statements, values and conditions


def test_statements_never_cut_a_name(spark):
    from tessera.operators import statements

    people = [("Alex", 1), ("Alex of the Seven Seas and All Ports", 2), ("Jo", 3), ("jo", 4), ("Jo Dunn", 5), ("J. Smith", 6), ("Alex", 1)]
    said = ["I report to Alex Smith.", "I report to Alex.", "I report to  Alex of the seven SEAS and all ports; truly", "I report to Alex of the seven seas.", "I report to Jo.", "I report to Jo Dunn", "I report to J. Smith! Yes.", "J. Smith is my manager", "Jo Dunn is my line manager.", "I report to Alex, mostly", "I report to " + "Alex" * 60, "I report to", "Hello. I no longer report to Alex . Bye"]
    messages = spark.createDataFrame(list(enumerate(said)), "m int, body string")
    got = statements.statements(messages, "m", "body", spark.createDataFrame(people, "name string, who int"), "name", "who")
    assert {r.m: (r.kind, r.target) for r in got.collect()} == {1: ("direct_report", 1), 2: ("direct_report", 2), 5: ("direct_report", 5), 6: ("direct_report", 6), 8: ("direct_report", 5), 12: ("negative_report", 1)}


def values_of(spark, *lines):
    from tessera.operators import extraction

    units = {"kg": ("kg", 1.0), "g": ("kg", 0.001), "lb": ("kg", 0.5), "mm": ("mm", 1.0), "rpm": ("rpm", 1.0)}
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    found = extraction.line_values(df, "line", {"weight": r"\bweight\b", "length": r"\blength\b"}, units, {"weight": "kg"})
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.i, r.label_no, r.value_no)):
        out.setdefault(r.i, []).append((r.attribute, round(r.value, 6), r.value_max, r.also, r.plus, r.unit, r.raw))
    return [out.get(i, []) for i in range(len(lines))]


def test_every_value_of_a_line(spark):
    def w(value, raw, value_max=None, also=None, plus=None, attribute="weight", unit="kg"):
        return (attribute, value, value_max, also, plus, unit, raw)

    got = values_of(
        spark, "Weight: 5 kg, 6 kg", "Weight 5 kg / shipping weight 7 kg", "Weight 5/6 kg", "Weight 1,200 to 1,300 kg ± 5%", "Weight (kg): 5 or 6 stone", "Weight [g] 500",
        "Weight at 5 kg, @6 kg, 7 kg", "Length 5 kg, 6mm; weight 3 mm 4 lb", "Weight 5 kg - 400 g", "weight 10 kg +/- 5 %, 3 kg ± 20 g", "no label 5 kg", "Weight", "Weight 1/2/3 kg", "WEIGHT 5KG", None,
    )
    assert got[0] == [w(5, "5 kg"), w(6, "6 kg")]
    assert got[1] == [w(5, "5 kg"), w(7, "7 kg")]
    assert got[2] == [w(5, "5/6 kg", also=6.0)]
    assert got[3] == [w(1200, "1,200 to 1,300 kg", value_max=1300.0)]
    assert got[4] == [w(5, "5")]
    assert got[5] == [w(0.5, "500")]
    assert got[6] == [w(7, "7 kg")]
    assert got[7] == [w(5, "5 kg", attribute="length"), w(6, "6mm", attribute="length", unit="mm"), w(2, "4 lb")]
    assert got[8] == []  # a range that falls
    assert got[9] == [w(10, "10 kg +/- 5 %", plus=0.5), w(3, "3 kg ± 20 g", plus=0.02)]
    assert got[10] == got[11] == got[14] == [] and got[13] == [w(5, "5KG")]


def test_conditions_and_qualifiers(spark):
    from tessera.operators import extraction

    cases = [
        ("Shipping weight", "40 kg less fuel, oil and water plus crate", "unspecified", ["Shipping weight", "less fuel, oil and water"]), ("Max. speed", "2200 rpm governed", "unspecified", ["Max. speed", "governed speed"]),
        ("Output", "5 kW at 50 Hz. . . see note, 3-phase, 80% power factor", "unspecified", ["at 50 Hz", "3-phase", "80% power factor"]), ("Air  tank capacity", "about 5 l; continuous", "rated", ["Air  tank capacity", "approximate value; tolerance unspecified"]),
        ("No load speed", "peak for hoist operation ,", "unspecified", ["for hoist operation"]), ("Weight", "weather 5 kg, whenever", "unspecified", []), ("Weight", "no-load", "no_load", []),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, label string, text string")
    got = {r.i: (r.q, r.c) for r in df.select("i", extraction.qualifier(F.col("text")).alias("q"), extraction.conditions(F.col("label"), F.col("text")).alias("c")).collect()}
    assert {i: got[i][1] for i in got} == {i: c[3] for i, c in enumerate(cases)}
    assert got[3][0] == "rated" and got[4][0] == "peak" and got[6][0] == "no_load" and got[5][0] == "unspecified"


def test_scope_folds_both_sides(spark):
    from tessera.operators import extraction

    df = spark.createDataFrame([("STRASSE",), ("Straße",), ("ｓｔｒａｓｓｅ ",), ("street",), (None,)], "x string")
    assert extraction.in_scope(df, {"x": " straße"}).count() == 3
