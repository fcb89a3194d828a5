"""The pipeline stage by stage on planted cases, and the registered queries with SQL against DuckDB."""

from __future__ import annotations

import glob
import os
import random

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries

FOLDER = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def planted(folder: str) -> tuple[list[tuple], dict[str, set[int]]]:
    """Documents in an invented language with junk, toxic texts, copies and a passage that two of them share."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices(LETTERS, k=rng.randrange(3, 9))) for _ in range(3000)]
    rows, cases = [], {"junk": set(), "toxic": set(), "copies": set(), "clean": set()}
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(80, 200))
        if i % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zwurgle", "vlaxendorf"])
            cases["toxic"].add(i)
        else:
            cases["clean"].add(i)
        rows.append((i, " ".join(words), "aa", "src", 0))
    for k, (i, edit) in enumerate([(1, False), (2, False), (3, True), (4, True), (5, True)]):
        words = rows[i][1].split()
        if edit:
            words[len(words) // 2] = "changed"
        rows.append((400 + k, " ".join(words), "aa", "src", 0))
        cases["copies"].add(400 + k)
    passage = " ".join(rng.choices(vocabulary, k=60))
    for i in (7, 8):
        rows[i] = (i, f"{rows[i][1]} {passage}", "aa", "src", 0)
    for i, text in ((500, None), (501, ""), (502, "12 34 !!")):
        rows.append((i, text, None, None, None))
        cases["junk"].add(i)
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s, _ in rows], cases


def test_stages(spark, tmp_path):
    rows, cases = planted(str(tmp_path))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in cases["toxic"])) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, frames = [], []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        frames.append(docs)
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in frames[:4])
    assert left[0] == {r[0] for r in rows} - cases["junk"]
    assert len(left[1] & cases["toxic"]) <= 5 and cases["clean"] <= left[1]
    assert not left[2] & cases["copies"] and cases["clean"] <= left[2]
    texts = {r.doc_id: r for r in frames[3].collect()}
    before = {r.doc_id: r.text for r in frames[2].collect()}
    assert len(before[8].split()) - len(texts[8].text.split()) == 60 and texts[7].text == before[7]
    assert {i for i in before if before[i] != texts[i].text} == {8}
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert left[4] == left[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect()))[0][0] == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = connection.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want[columns].itertuples(index=False, name=None))


def test_each_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
