"""Communities, validity, folds, samples, nested sources, jobs and streams against small brute-force versions."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import communities as N
from tessera.operators import graph as R
from tessera.operators import nested as J
from tessera.operators import quality as Q
from tessera.operators import validity as V
from tessera.operators.predicates import RequestError
from tessera.sources import geojson, readers, sinks
from tessera.streaming import ingest

# Communities


def plain_modularity(edges, of) -> float:
    m, total, inside = sum(w for *_, w in edges), {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            total[of[x]] = total.get(of[x], 0) + w
        inside += w if of[a] == of[b] else 0
    return inside / m - sum(t * t for t in total.values()) / (4 * m * m)


def plain_greedy(edges, seed) -> dict:
    """One node after another to its best community, then communities as nodes, until nothing gains."""
    rng, near = random.Random(seed), {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = near.get(a, {}).get(b, 0) + w
    m, k = sum(w for *_, w in edges), {u: sum(n.values()) for u, n in near.items()}
    member = {u: u for u in near}
    while True:
        of, total, order, moved, any_move = {u: u for u in near}, dict(k), list(near), True, False
        rng.shuffle(order)
        while moved:
            moved = False
            for u in order:
                total[of[u]] -= k[u]
                links: dict = {}
                for v, w in near[u].items():
                    links[of[v]] = links.get(of[v], 0) + w
                gain = {c: w - k[u] * total[c] / (2 * m) for c, w in links.items()}
                best = max(gain, key=gain.get, default=of[u])
                if best != of[u] and gain[best] > links.get(of[u], 0) - k[u] * total[of[u]] / (2 * m) + 1e-12:
                    of[u], moved, any_move = best, True, True
                total[of[u]] += k[u]
        if not any_move:
            return member
        member = {u: of[c] for u, c in member.items()}
        up: dict = {}
        up_k: dict = {}
        for u, n in near.items():
            up_k[of[u]] = up_k.get(of[u], 0) + k[u]
            own = up.setdefault(of[u], {})
            for v, w in n.items():
                if of[v] != of[u]:
                    own[of[v]] = own.get(of[v], 0) + w
        near, k = up, up_k


def random_graph(seed, groups=5, n=70, inside=0.4, outside=0.03):
    rng = random.Random(seed)
    return [(i, j, float(rng.randrange(1, 4))) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i % groups == j % groups else outside)]


def test_communities_are_as_good_as_a_greedy_run(spark):
    """Planted communities, planted ones in noise, and stars; three graphs in the same jobs."""
    stars = [(h, 1000 + h * 20 + i, 1.0) for h in range(4) for i in range(12)]
    graphs = [random_graph(1, inside=0.7, outside=0.02), random_graph(2, outside=0.12), stars]
    rows = [(a, b, w, g) for g, edges in enumerate(graphs) for a, b, w in edges] + [(1, 1, 5.0, 0), (2, None, 1.0, 0), (1, 2, 0.0, 0)]
    df = spark.createDataFrame(rows, "a long, b long, w double, g int")
    found: dict = {}
    for r in N.communities(df, "a", "b", "w", [F.col("g") == i for i in range(3)]).collect():
        found.setdefault(r.run, {})[r.node] = r.community
    for g, edges in enumerate(graphs):
        of = {x: found[g][x] for e in edges for x in e[:2]}
        best = max(plain_modularity(edges, plain_greedy(edges, s)) for s in range(3))
        assert plain_modularity(edges, of) >= 0.98 * best
        assert all(c == min(n for n in found[g] if found[g][n] == c) for c in of.values())
    planted = {x % 5: found[0][x] for x in range(70)}
    assert all(found[0][x] == planted[x % 5] for x in range(70)) and len(set(planted.values())) == 5
    assert len({found[2][x] for e in stars for x in e[:2]}) == 4 and set(found[0]) == set(found[2])
    members = spark.createDataFrame([(n, c) for n, c in found[1].items()], "node long, community long")
    assert abs(N.modularity(df.where("g = 1"), "a", "b", "w", members) - plain_modularity(graphs[1], found[1])) < 1e-9


def test_stability_equals_plain_python(spark):
    rng = random.Random(4)
    runs = [{n: rng.randrange(6) for n in range(60)} for _ in range(4)]
    runs[0][60] = 99
    for r in runs[1:]:
        r[60] = 98
    members = spark.createDataFrame([(i, n, c) for i, r in enumerate(runs) for n, c in r.items()], "run int, node long, community long")
    want = {}
    for c in set(runs[0].values()):
        own = {n for n, x in runs[0].items() if x == c}
        if len(own) > 1:
            best = [max(len(own & other) / len(own | other) for other in ({n for n, x in r.items() if x == d} for d in set(r.values()))) for r in runs[1:]]
            want[c] = (len(own), round(sum(best) / 3, 4))
    assert {r.community: (r.members, r.mean_best_jaccard) for r in N.stability(members).collect()} == want


def test_no_edges_no_communities(spark):
    none = spark.createDataFrame([], "a long, b long, w double")
    assert N.communities(none, "a", "b", "w").count() == 0
    assert N.modularity(none, "a", "b", "w", spark.createDataFrame([], "node long, community long")) == 0.0


# Parents over time


def day(n: int) -> date:
    return date(2024, 1, 1) + timedelta(n)


def random_candidates(seed, people=14, rows=60):
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        a, b = sorted(rng.sample(range(12), 2))
        start, end = (None if rng.random() < 0.2 else day(a)), (None if rng.random() < 0.2 else day(b))
        out.append((rng.randrange(people), rng.randrange(people), rng.choice([0, 1, 2, 2, 2]), rng.choice([None, 0.3, 0.6, 0.65, 0.9]), start, end))
    return out


def plain_parent(rows, child, d):
    own = [(p, q, s or 0.0) for c, p, q, s, a, b in rows if c == child and p != c and (a is None or a <= d) and (b is None or d < b)]
    if not own:
        return None
    top = min(q for _, q, _ in own)
    score: dict = {}
    for p, q, s in own:
        if q == top:
            score[p] = max(score.get(p, 0.0), s)
    ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    if top <= 1:
        return ranked[0][0] if len(ranked) == 1 else None
    sure = ranked[0][1] >= 0.55 and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= 0.08)
    return ranked[0][0] if sure else None


CANDIDATES = "child int, parent int, priority int, score double, start date, end date"


@pytest.mark.parametrize("seed", range(1, 4))
def test_parents_and_cycles_over_time_equal_brute_force(spark, seed):
    rows = random_candidates(seed)
    held = V.parents_in_force(spark.createDataFrame(rows, CANDIDATES), "child", "parent", "priority", "score", "start", "end").cache()
    spans = [tuple(r) for r in held.select("child", "parent", "lo", "hi").collect()]
    cycles = [tuple(r) for r in V.cycles_over_time(held).select("node", "lo", "hi").collect()]
    some = False
    for n in range(-2, 16):
        d = day(n)
        parent = {c: plain_parent(rows, c, d) for c in range(14)}
        assert {c: p for c, p, a, b in spans if a <= d < b} == {c: p for c, p in parent.items() if p is not None}
        on = set()
        for c in parent:
            at, steps = parent[c], 0
            while at is not None and at != c and steps < 20:
                at, steps = parent.get(at), steps + 1
            if at == c:
                on.add(c)
        assert {c for c, a, b in cycles if a <= d < b} == on
        some = some or bool(on)
    assert some and len(cycles) == len(set(cycles))
    # proposals: each alone in the place of its child's parents
    rng = random.Random(seed + 50)
    asked = [(i, rng.randrange(14), rng.randrange(14), day(a), day(a + rng.randrange(1, 6))) for i, a in enumerate(rng.choices(range(10), k=30))]
    got = {r.i: r.in_cycle for r in V.closes_cycle(held, spark.createDataFrame(asked, "i int, c int, p int, s date, e date"), "c", "p", "s", "e").collect()}
    for i, c, p, s, e in asked:
        hit = False
        for n in range((e - s).days):
            parent, at, steps = {x: plain_parent(rows, x, s + timedelta(n)) for x in range(14)}, p, 0
            while at is not None and at != c and steps < 20:
                at, steps = parent[at], steps + 1
            hit = hit or at == c
        assert got[i] == hit


def test_a_long_ring_over_time(spark):
    rows = [(i, (i + 1) % 40, day(i % 3), day(9 - i % 2)) for i in range(40)] + [(100, 3, day(0), day(20))]
    ring = V.cycles_over_time(spark.createDataFrame(rows, "child int, parent int, lo date, hi date"))
    assert sorted(map(tuple, ring.collect())) == [(i, day(2), day(8)) for i in range(40)]
    assert V.cycles_over_time(spark.createDataFrame([], "child int, parent int, lo date, hi date")).count() == 0


# Folds


def test_skip_budget_passes_over_what_does_not_fit(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, *range(1, 40)])) for k in range(20) for i in range(rng.randrange(1, 30))]
    got: dict = {}
    for r in A.greedy_budget(spark.createDataFrame(rows, "k int, i int, s int"), ["k"], ["i"], "s", 60, []).collect():
        got.setdefault(r.k, []).append((r.i, r.used))
    for k in range(20):
        used, want, passed = 0, [], False
        for _, i, s in sorted(r for r in rows if r[0] == k):
            if used + (s or 0) <= 60:
                used += s or 0
                want.append((i, float(used)))
        assert sorted(got.get(k, [])) == want
    with pytest.raises(RequestError):
        A.greedy_budget(spark.createDataFrame(rows, "k int, i int, s int"), ["k"], ["i"], "s", 60, [], longest=5)


def test_tolerance_lines_move_with_their_rows(spark):
    rng = random.Random(2)
    rows = [(k, i, round(rng.uniform(0, 80), 2), rng.choice([1.0, 8.0, 12.0])) for k in range(8) for i in range(40)] + [(9, 1, None, 3.0), (9, 2, 3.0, None)]
    got = {(r.k, r.i): r.line for r in A.tolerance_groups(spark.createDataFrame(rows, "k int, i int, y double, h double"), ["k"], "y", "h", "i").collect()}
    from statistics import median

    want = {}
    for k in range(8):
        lines: list = []
        for y, i, h in sorted((y, i, h) for q, i, y, h in rows if q == k):
            if lines and abs(y - median(a for a, _ in lines[-1])) <= max(2.0, min(h, median(b for _, b in lines[-1])) * 0.4):
                lines[-1].append((y, h))
            else:
                lines.append([(y, h)])
            want[k, i] = len(lines)
    assert got == want


# Samples and validation


@pytest.mark.parametrize(("nodes", "edges"), [(24, 40), (5, 40), (9, 6), (2, 2)])
def test_first_come_sample_equals_a_plain_loop(spark, nodes, edges):
    rng = random.Random(nodes)
    rows = [(i, rng.randrange(30), rng.randrange(30), rng.choice("ab")) for i in range(400)] + [(400, None, 1, "a")]
    got = [tuple(r)[:3] for r in R.first_sample(spark.createDataFrame(rows, "i int, a int, b int, r string"), "a", "b", "r", "i", nodes, edges).orderBy("place").collect()]
    chosen, want = set(), []
    for _, a, b, r in rows:
        if a is None or a == b or (a, b, r) in want or len(want) >= edges or len(chosen | {a, b}) > nodes:
            continue
        chosen |= {a, b}
        want.append((a, b, r))
    assert got == want


def test_every_planted_fault_is_found(spark):
    people = [(1, "Ann", "5", "2024-01-31", 1), (1, "Ann", "5", "2024-01-31", 1), (2, "Bob", "x", "31.1.", 1), (3, " ", None, None, 9), (4, None, "1e3", "2024-02-30", None), (5, "Eve", "7", "2024-01-01", 2), (5, "Eva", "7", "2024-01-01", 2), (None, "Zed", "1", None, 1)]
    tables = {"people": spark.createDataFrame(people, "id int, name string, size string, since string, unit int"), "units": spark.createDataFrame([(1, "team"), (2, "zoo")], "id int, kind string")}
    rules = [Q.Rule("people", "unique", "id"), Q.Rule("people", "required", "id"), Q.Rule("people", "required", "name"), Q.Rule("people", "number", "size"), Q.Rule("people", "date", "since"), Q.Rule("people", "reference", "unit", to=("units", "id")), Q.Rule("units", "one_of", "kind", ("team", "group"))]
    got = sorted(map(tuple, Q.dataset_faults(tables, {"people": "id", "units": "id"}, rules).collect()), key=str)
    want = [
        ("people", "1", "id", "duplicate_id"), ("people", "2", "since", "not_a_date"), ("people", "2", "size", "not_a_number"), ("people", "3", "name", "missing"), ("people", "3", "unit", "unknown_units"),
        ("people", "4", "name", "missing"), ("people", "4", "since", "not_a_date"), ("people", "5", "id", "conflicting_id"), ("people", None, "id", "missing"), ("units", "2", "kind", "unknown_value"),
    ]
    assert got == sorted(want, key=str)


# Sources


def test_features_of_many_blocks_equal_a_plain_parse(spark, tmp_path):
    rng = random.Random(6)

    def feature(i):
        ring = [[[rng.random(), rng.random()] for _ in range(rng.randrange(4, 9))]]
        name = rng.choice(['a"b', "back\\", "\\\\\"", "{[", "é}]", '{"type": "Feature"}', "x" * rng.randrange(40)])
        many = rng.random() < 0.3
        return {"geometry": {"coordinates": [ring, ring] if many else ring, "type": "MultiPolygon" if many else "Polygon"}, "properties": {"code": f"{i}", "name": name, "more": {"a": [{}]}}, "type": "Feature"}

    files = {}
    for n, indent in (("a", None), ("b", 1), ("c", None)):
        features = [feature(f"{n}{i}") for i in range({"a": 60, "b": 40, "c": 0}[n])]
        files[n] = {"type": "FeatureCollection", "name": 'say "hi" [{', "crs": {"properties": {"list": [{"no": "feature"}]}}, "notes": [{"type": "Note"}], "features": features}
        (tmp_path / f"{n}.json").write_text(json.dumps(files[n], indent=indent, ensure_ascii=n == "a"))
    (tmp_path / "empty.json").write_text("")
    want = sorted((f["properties"]["code"], f["properties"]["name"], f["geometry"]["type"], str(p)) for x in files.values() for f in x["features"] for p in (f["geometry"]["coordinates"] if f["geometry"]["type"] == "MultiPolygon" else [f["geometry"]["coordinates"]]))
    for block in (97, 4096, 1 << 25):
        got = geojson.geojson_features(spark, f"{tmp_path}/*.json", ["code", "name"], block_bytes=block)
        assert sorted((r.code, r.name, r.kind, str(r.rings)) for r in got.collect()) == want
    tasks = geojson.feature_texts(spark, f"{tmp_path}/a.json", 2000).select(F.spark_partition_id()).distinct().count()
    assert tasks > 3
    with pytest.raises(Exception, match="a feature of more than"):
        geojson.feature_texts(spark, f"{tmp_path}/a.json", 97, max_feature_bytes=50).count()


def test_csv_kinds_and_quarantine(spark, tmp_path):
    (tmp_path / "m.csv").write_text("From,To,Subject,Body\na@x,b@x,hi,text\na@x,,none,\n")
    (tmp_path / "r.csv").write_text('Employee ID,Full Name,E-mail\n1,"Ann, A.",a@x\n2,Bob\n3, ,c@x\n4,Dan,d@x,extra\n5,Eve,e@x\n')
    kinds = {"messages": ({"sender": ["from"], "recipient": ["to"], "subject": []}, ["sender", "recipient"]), "roster": ({"person": ["employee id"], "name": ["full name"], "email": ["e-mail"]}, ["name"])}
    assert [readers.csv_kind(spark, str(tmp_path / f), kinds) for f in ("m.csv", "r.csv")] == ["messages", "roster"]
    with pytest.raises(ValueError):
        readers.csv_kind(spark, str(tmp_path / "m.csv"), {"roster": kinds["roster"]})
    sound, broken = readers.csv_with_rejects(spark, str(tmp_path / "r.csv"), *kinds["roster"], columns=["Employee ID", "Full Name", "E-mail"])
    assert sorted(map(tuple, sound.collect())) == [("1", "Ann, A.", "a@x"), ("5", "Eve", "e@x")]
    assert sorted(r.reason for r in broken.collect()) == ["missing_name", "wrong_width", "wrong_width"]


# Jobs and snapshots


def test_a_job_counts_what_it_writes(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 == 3, "rejected").otherwise("accepted").alias("outcome"))
    facts = sinks.run_job(rows, "outcome", ["accepted", "rejected"], str(tmp_path / "job"))
    assert facts["rows"] == 100 and facts["outcomes"] == {"accepted": 90, "rejected": 10}
    assert json.loads(spark.read.text(str(tmp_path / "job.manifest")).first()[0]) == facts
    assert spark.read.parquet(str(tmp_path / "job/outcome=rejected")).count() == 10
    for i, kwargs in enumerate(({"max_rows": 99}, {"max_lost": 0.05})):
        with pytest.raises(RequestError):
            sinks.run_job(rows, "outcome", ["accepted", "rejected"], str(tmp_path / f"bad{i}"), **kwargs)
        assert not (tmp_path / f"bad{i}.manifest").exists()
    with pytest.raises(RequestError):
        sinks.run_job(rows, "outcome", ["accepted"], str(tmp_path / "bad2"))
    assert sinks.run_job(rows.limit(0), "outcome", ["accepted"], str(tmp_path / "none"))["rows"] == 0


def test_snapshots_are_what_their_manifest_says_and_only_go_forward(spark, tmp_path):
    root = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, x string")
    assert sinks.current_snapshot(spark, root) is None
    sinks.publish_snapshot(df, root, 3)
    sinks.publish_snapshot(df.repartition(2, "x").limit(2), root, 5)
    assert sinks.current_snapshot(spark, root) == 5 and sinks.read_snapshot(spark, root).count() == 2 and sinks.read_snapshot(spark, root, 3).count() == 3
    for seq in (4, 5):
        with pytest.raises(RequestError):
            sinks.publish_snapshot(df, root, seq)
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "i int, x string").write.mode("overwrite").parquet(f"{root}/snapshot-000003")
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, root, 3)
    digest = [d.agg(sinks.table_digest(d.columns)).first()[0] for d in (df, df.orderBy(F.desc("i")), df.select("x", "i"), df.distinct(), df.limit(0))]
    assert digest[0] == digest[1] == digest[2] and len(set(digest)) == 3


def test_export_budgets_hash_and_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "=a"), (2, "b")], "i int, x string")
    assert sinks.export_csv(df, str(tmp_path / "out"), 5, one_file=True, max_bytes=100, bom=True) == 2
    text = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert text.decode("utf-8-sig").splitlines() == ["i,x", "1,'=a", "2,b"] and text[:3] == b"\xef\xbb\xbf"
    assert json.loads(spark.read.text(str(tmp_path / "out.manifest")).first()[0])["rows"] == 2
    with pytest.raises(RequestError):
        sinks.export_csv(df, str(tmp_path / "out2"), 5, max_bytes=5)
    assert not (tmp_path / "out2").exists()


# Nested documents


def test_statements_left_out_have_a_reason(spark):
    def claim(value=None, kind="value", **more):
        return {"mainsnak": {"snaktype": kind, **({"datavalue": {"type": "t", "value": value}} if value is not None else {})}, **more}

    docs = [
        (1, json.dumps({"claims": {"P1": [claim("a"), claim("b", rank="preferred"), claim("c", rank="deprecated")], "P2": [claim(kind="novalue"), claim(kind="somevalue"), claim(), claim("d", qualifiers={"end": [1]})]}})),
        (2, json.dumps({"claims": {"P1": [claim("e")], "P3": "no list", "P4": []}})), (3, "{"), (4, None), (5, "[]"), (6, '{"claims": 3}'),
    ]
    found = J.statements_of(spark.createDataFrame(docs, "i int, d string"), "i", F.col("d"))
    got = {(r.i, r.property, r.number): (r.value, r.outcome) for r in found.collect()}
    assert got == {
        (1, "P1", 0): ("a", "admitted"), (1, "P1", 1): ("b", "admitted"), (1, "P1", 2): ("c", "deprecated_rank"), (1, "P2", 0): (None, "no_value"), (1, "P2", 1): (None, "unknown_value"),
        (1, "P2", 2): (None, "without_datavalue"), (1, "P2", 3): ("d", "has_ended"), (2, "P1", 0): ("e", "admitted"),
    }
    assert sorted(map(tuple, J.evidence_of(found, "i", {"P1": "is"}).collect())) == [(1, "is", "b", True), (2, "is", "e", False)]


# Streams


def test_sessions_and_timers_replay(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(hours=h)) for h in (0, 1, 2, 30, 31)] + [("b", start + timedelta(hours=h)) for h in (0, 99, 100)] + [("c", start + timedelta(hours=100))]
    spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, kind="parquet")
    sessions = ingest.final_state(ingest.session_counts(stream, "t", ["k"], "5 hours", late="30 days"))
    assert sorted((r.k, r.n) for r in sessions.collect()) == [("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1)]
    sliding = ingest.final_state(ingest.sliding_counts(stream, "t", ["k"], "2 hours", "1 hour", late="30 days"))
    assert sum(r.n for r in sliding.collect()) == 2 * len(rows)
    for _ in range(2):  # the second run has nothing new
        silent = ingest.appended(ingest.silences(stream, "k", "t", 24), str(tmp_path / "silent"))
        assert [(r.k, r.last_seen, r.n) for r in silent.collect()] == [("a", start + timedelta(hours=31), 5)]


# Search, baselines and rosters


def test_searches_by_token_and_scope(spark):
    from tessera.operators import evidence as E

    df = spark.createDataFrame([(1, "The License works", [1]), (2, "license work", [2, 3]), (3, None, [1]), (4, "work-license", None)], "i int, t string, about array<int>")
    assert [r.ok for r in df.orderBy("i").select(E.all_tokens(F.col("t"), ["License", "WORK"]).alias("ok")).collect()] == [False, True, False, True]
    assert [r.i for r in E.searched(df, "t", ["lic", "work"], "about", [1, 3]).orderBy("i").collect()] == [1, 2]
    assert E.searched(df, "t", ["lic"], "about", []).count() == 3
    assert [r.i for r in E.preview(df, "i", "t", "license wor").collect()] == [1, 2, 4] and E.preview(df, "i", "t", "lic ").count() == 0


def test_baselines_are_saved_and_compared(spark, tmp_path):
    from tessera.operators import evidence as E

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, x string")
    E.save_baseline(df, "i", str(tmp_path / "base"), "findings")
    now = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "i int, x string")
    assert {r.item: r.change for r in E.since_baseline(now, "i", str(tmp_path / "base")).collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}


def test_neighbourhoods_are_bounded(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "a", "e"), (5, "x", "y")], "e int, s string, t string")
    near, reasons = R.neighbourhood(edges, "e", "s", "t", "a", hops=1)
    assert {r.e for r in near.collect()} == {1, 4} and not reasons
    near, _ = R.neighbourhood(edges, "e", "s", "t", "a", hops=2)
    assert {(r.e, r.hop) for r in near.collect()} == {(1, 0), (4, 0), (2, 1)}
    near, reasons = R.neighbourhood(edges, "e", "s", "t", "a", hops=1, per_node=1)
    assert {r.e for r in near.collect()} == {1} and reasons == {"per_node_budget"}
    assert R.neighbourhood(edges, "e", "s", "t", "?")[0].count() == 0


def test_labels_stand_once_in_a_quote_that_stands_once(spark):
    from tessera.functions.text import labels_grounded

    rows = [("ab cd ab", "cd ab", ["cd", "ab"]), ("ab cd ab", "ab", ["ab"]), ("ab cd", "ab cd", ["a", "x"]), ("abab cd", "abab", ["ab"]), ("abc", "abc", []), (None, "a", ["a"]), ("abc", "", []), ("abc", "ab", [""]), ("abc", "ab", None)]
    df = spark.createDataFrame(rows, "t string, q string, l array<string>")
    assert [r.ok for r in df.select(labels_grounded(F.col("t"), F.col("q"), F.col("l")).alias("ok")).collect()] == [True, False, False, False, True, False, False, False, False]


def test_units_of_a_roster(spark):
    from tessera.operators import evidence as E

    rows = [("1", ["Ann"], "Sales ", "2"), ("2", ["Bob", "Ann"], "sales", "ann"), ("3", ["Cy"], None, "3"), ("4", ["Dee"], " ", "cy")]
    people, units = E.roster_links(spark.createDataFrame(rows, "p string, names array<string>, unit string, manager string"), "p", "names", "unit", "manager")
    assert {r.p: (r.manager_outcome, r.manager_id) for r in people.collect()} == {"1": ("matched", "2"), "2": ("ambiguous", None), "3": ("self", None), "4": ("matched", "3")}
    assert [(r.name, r.people) for r in units.collect()] == [("Sales", 2)] and people.where("unit_id is null").count() == 2
