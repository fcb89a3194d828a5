"""The corpus pipeline: documents in, packed training sequences out.

Each stage is one corpus operator; its result is written as Parquet and read again as the next stage's input. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, packing, shared, simhash, substrings, toxicity
from tessera.session import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the languages learned from the rows' lang, go.

    Null and empty texts have no letters. Rows are judged one by one, so repeated rows share their fate; an empty table
    stays empty; all columns stay, whatever their names.
    """
    ship(spark)
    return langid.in_known_language(docs, langid.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on labels scores 0.5 or more go.

    Null and empty texts are scored like others. Rows are judged one by one, so repeated rows share their fate; an empty
    table stays empty, and without labels all rows stay; all columns stay, whatever their names.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~shared.is_held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label"))))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    SimHash fingerprints that operator 9 finds near are compared first, by their sets of five-word shingles; near copies whose
    fingerprints lie further apart are found by the shingles they share.

    Texts without words, null ones among them, are copies of each other. Of repeated rows one stays; rows without an id
    all stay; an empty table stays empty; all columns stay, whatever their names.
    """
    ship(spark)
    return simhash.representatives(docs, shingle=5)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 20-word window that also starts earlier are cut out; documents without such words stay as
    they are, others become their kept words joined by one space.

    Null texts stay null. Repeated rows count as documents one after the other, so the later ones lose their windows; an
    empty table stays empty; all columns stay, whatever their names, and n_chars is that of the new text.
    """
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substrings.remove_repeats(docs, keep=tuple(others))
    names = cut.columns[len(cut.columns) - len(others) :]
    length = [F.length("kept_text").cast("long").alias("n_chars")] if "n_chars" in docs.columns else []
    return cut.select("doc_id", F.col("kept_text").alias("text"), *[F.col(n).alias(o) for n, o in zip(names, others, strict=True)], *length).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences of 1024 token ids; one row for each piece.

    Null and empty texts are their closing id alone. Repeated rows are packed as often as they occur; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", one_of_near_copies),
    ("substring dedup", no_repeated_passages),
    ("packing", packed),
]

#: SQL has no operators for these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
