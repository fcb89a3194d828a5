"""Neighbours, whitening and spelling variants against brute force, with the odd cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import neighbours, queries, spelling, whitening

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<float>, score double, node long, rank int"


def rows_of(name: str, folder: str = FOLDER) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def odd_vectors() -> list[tuple]:
    """Ties, copies, one vector held by a third of the rows, nulls, zeros, bad entries, repeated rows, missing ids."""
    rng = random.Random(8)
    found = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(200)]
    found += [(i, [1.0, 2.0, -1.0, 0.0, 3.0, 1.0]) for i in range(200, 300)]
    found += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [float("inf")] + [1.0] * 5), (305, [])]
    return [(i, v, 0.5, 7, 3) for i, v in [*found, found[4], found[4], found[220], (None, [9.0] * 6), (306, [2.0, 2.0])]]


def brute_neighbours(rows: list[tuple], every: int, k: int) -> list[tuple]:
    sound = {(i, tuple([*v, 0, 0, 0, 0][: max(6, len(v))])) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q, own in sorted(sound):
        if q % every == 0:
            best = sorted((-float(np.dot(own, v)), i) for i, v in sound if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_few_vectors_are_searched_whole(spark):
    rows = odd_vectors()
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_neighbours(rows, 20, 20)
    few = neighbours.nearest(spark.createDataFrame(rows[:5], VECTORS), F.col("vec_id") % 2 == 0, k=20)
    assert sorted(map(tuple, few.collect())) == brute_neighbours(rows[:5], 2, 20)


def test_nothing_to_search(spark):
    rows = odd_vectors()
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame(rows[300:306], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_recall_and_scores(spark, spread):
    """Many regions, hot lists that are cut, several batches; with vectors of one and of very different lengths."""
    rows = rows_of("embeddings", LARGER)
    rng = np.random.default_rng(1)
    x = np.array([r["embedding"] for r in rows]) * np.exp(spread * rng.random((len(rows), 1)))
    x[:300] = x[0] + rng.normal(0, 0.01, (300, x.shape[1]))  # one crowded list
    ids = np.array([r["vec_id"] for r in rows])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, region_rows=256, chunk_rows=100, batch_queries=30).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    at = {i: n for n, i in enumerate(ids.tolist())}
    hits = 0
    assert set(got) == {i for i in at if i % 20 == 0}
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {i for _, i, _ in own}
        scores = np.array([s for _, _, s in own])
        assert np.allclose(scores, [x[at[i]] @ x[at[q]] for _, i, _ in own], rtol=1e-12, atol=1e-12) and (np.diff(scores) <= 0).all()
        best = sorted((-float(x[n] @ x[at[q]]), i) for i, n in at.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in own})
    assert hits / (20 * len(got)) >= 0.9


def test_abandoned_candidates():
    """Most rows are abandoned before their last block, and none of the best is lost without a margin to speak of."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 128))
    lists = neighbours.fitted(x[:1000], float((x**2).sum(axis=1).max()), 1)
    turned = lists.lifted(x) @ lists.rotation
    assert np.allclose(lists.rotation @ lists.rotation.T, np.eye(129))
    scan = neighbours.Scan(x[:50], lists.asked(x[:50]) @ lists.rotation, np.full(50, -np.inf), lists.largest, 10)
    for a in range(0, 4000, 500):
        scan.over(np.arange(50), np.arange(a, a + 500), x[a : a + 500], [turned[a : a + 500, e : e + 16] for e in range(0, 129, 16)])
    best = [set(np.argsort(-(x @ x[i]))[:10]) for i in range(50)]
    found = [set(scan.node[scan.query == i]) for i in range(50)]
    assert np.mean([len(a & b) / 10 for a, b in zip(best, found, strict=True)]) > 0.97 and scan.whole < 0.6 * scan.compared


# Whitening


def brute_whitening(rows: list[tuple], most: int) -> dict:
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in rows], np.int64).reshape(len(rows), width)
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    e, v = np.linalg.eigh(far.T.astype(float) @ far / n**3)
    e, v = e[::-1], v[:, ::-1]
    most = min(most, int((e > 1e-9 * e[0]).sum()))
    return {"deviation": (far**2).sum(axis=1).tolist(), "whitened": (far / n) @ v[:, :most] / np.sqrt(e[:most]), "explained": e[:most] / e.sum(), "n": n}


def checked_whitening(spark, rows: list[tuple], most: int = 8) -> int:
    df = spark.createDataFrame([(i, v, 1.0, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, n double, component int, x int")
    got = whitening.whiten(df.repartition(3), most).toPandas().sort_values(["vec_id", "component"])
    want = brute_whitening(sorted(rows), most)
    k = len(want["explained"])
    assert len(got) == len(rows) * k and (got.n == want["n"]).all() and (got.identity_error <= 1e-9).all()
    assert got.deviation.to_list() == [d for d in want["deviation"] for _ in range(k)]
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), want["explained"], rtol=1e-9)
    mine = got.whitened.to_numpy().reshape(-1, k)
    assert np.allclose(mine * np.sign((mine * want["whitened"]).sum(axis=0)), want["whitened"], atol=1e-6)
    return k


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    mixing = rng.normal(size=(12, 12))
    assert checked_whitening(spark, [(i, (rng.normal(size=12) @ mixing).tolist()) for i in range(500)]) == 8
    assert checked_whitening(spark, [(i, (rng.normal(size=5) * [90, 9, 5, 2, 1]).tolist()) for i in range(200)]) == 5


def test_whitening_of_dependent_and_steep_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-40, 41, size=(300, 3)) / 1024.0 * [2000.0, 40.0, 1.0]
    dependent = np.concatenate((base, base[:, :1] + base[:, 1:2], np.full((300, 1), 3.0)), axis=1)
    assert checked_whitening(spark, [(i, v.tolist()) for i, v in enumerate(dependent)]) == 3


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")]), (3, [None])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0])], schema)).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and sorted(r.vec_id is None for r in got) == [False, False, True]


def test_exact_deviations_beyond_int64_steps():
    known = whitening.Moments(10**9, [5 * 10**14 + 3], [400_000], [600_000])
    assert known.deviations(np.array([[500_000]])) == [(10**9 * 500_000 - 5 * 10**14 - 3) ** 2]
    with pytest.raises(OverflowError):
        import pyarrow as pa

        pa.array(known.deviations(np.array([[600_000]])), pa.int64())


def test_op12_on_the_table(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in rows_of("embeddings")]
    got = queries.op12_whitening(spark, FOLDER).toPandas().sort_values(["vec_id", "component"])
    want = brute_whitening(sorted(rows), 8)
    mine = got.whitened.to_numpy().reshape(-1, 8)
    assert got.deviation.to_list()[::8] == want["deviation"] and np.allclose(got.explained.to_numpy()[:8], want["explained"], rtol=1e-9)
    assert np.allclose(mine * np.sign((mine * want["whitened"]).sum(axis=0)), want["whitened"], atol=1e-6) and got.identity_error.max() < 1e-9


def test_op11_recall_on_the_table(spark):
    rows = rows_of("embeddings", LARGER)
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got: dict = {}
    for r in queries.op11_neighbours(spark, LARGER).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for q, found in got.items():
        order = np.lexsort((ids, -(x @ x[np.flatnonzero(ids == q)[0]])))
        share.append(len({int(i) for i in [i for i in ids[order] if i != q][:20]} & found) / 20)
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and np.mean(share) >= 0.9


# Spelling


def plain_near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs: list[tuple], shortest: int = 7, least: int = 2, times: int = 10, one_in: int = 31) -> dict:
    counts: Counter = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run
            if len(word) >= shortest:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    holes: dict = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
    near: dict = {w: set() for w in words}
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_found(rows) -> dict:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_op13_equals_brute_force(spark):
    got = queries.op13_spelling(spark, "/root/testdata/sf0.01")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    want = brute_variants([(d["doc_id"], d["text"]) for d in rows_of("documents", "/root/testdata/sf0.01")])
    assert as_found(rows) == want and len(rows) == len(want)
    assert sum(v[0] is not None for v in want.values()) > 50


def typos(rng: random.Random) -> list[tuple]:
    base = ["".join(rng.choices("abcdeàé÷", k=rng.randrange(7, 12))) for _ in range(40)] + ["a" * 20, "ab" * 30, "x" * 70, "xy" * 300]
    words = []
    for w in base:
        words += [w] * rng.choice([40, 300])
        for _ in range(rng.randrange(12)):
            i, c = rng.randrange(len(w)), rng.choice("abcdeàé")
            edit = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[i:] + w[:i]])
            words += [edit.upper() if rng.random() < 0.3 else edit] * rng.choice([1, 2, 3, 30])
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::50]) + "  1" * (i % 3), "n", 1, "w") for i in range(50)]
    return [*docs, docs[3], docs[3], (None, "Missing missing MISSING", None, None, None), (60, None, "", 0, ""), (61, "", "", 0, ""), (62, " \n", "", 0, "")]


@pytest.mark.parametrize(("groups", "chunk"), [(16, 2048), (4, 5), (3, 1)])
def test_variants_equal_brute_force(spark, groups, chunk):
    """Whole tries, and tries cut at every depth with leaves of more words than a chunk."""
    docs = typos(random.Random(groups))
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n int, root string")
    got = spelling.variants(df, groups=groups, chunk=chunk).collect()
    want = brute_variants(docs)
    assert as_found(got) == want and len(got) == len(want) and any(v[3] > 3 for v in want.values())


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(df).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words")], df.schema)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=6), st.text("abé", min_size=1, max_size=6))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == plain_near(a, b)
    long = "q" * spelling.SHORT
    x, y = spelling.Words([a, long + a]), spelling.Words([b, long + b])
    assert x.near(np.array([0, 1]), y, np.array([0, 1])).tolist() == [plain_near(a, b)] * 2


@pytest.mark.parametrize("name", ["op11_neighbours", "op12_whitening", "op13_spelling"])
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
