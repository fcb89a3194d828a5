"""The registered queries of the corpus operators: each applies one operator, with production parameters, to its
whole table and derives the digest columns. ORACLES holds their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import chat, langid, media, neighbours, packing, pieces, search, simhash, spelling, substrings, toxicity, urlfilter, whitening
from tessera.llm.shared import is_held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"), window=20, with_text=False)


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_pieces, n_unspelled (characters spelled by byte pieces), score, ids_crc32, decoded_sha256."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_texts(table(spark, folder, "documents"), model, ["doc_id"])
    keep = ["doc_id", "score", "n_unspelled"]
    return pieces.decode_ids(encoded, model, keep).select("doc_id", "n_pieces", "n_unspelled", "score", "ids_crc32", "decoded_sha256")


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled table is the urls that a rule judges, 2,000 of them."""
    pages = table(spark, folder, "pages")
    judged = urlfilter.judge(pages, URL_RULES, urlfilter.labelled_by_rules(pages, URL_RULES), ["page_id"], max_rows=2000)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_media(spark: SparkSession, folder: str) -> DataFrame:
    stored = media.to_media(table(spark, folder, "documents"), ["doc_id"])
    found = media.describe_media(stored, ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature_text().alias("feature"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, folder, "documents"), tokenizer, public_tokenizers.PATTERN, capacity=1024, closing_id=0, cached_words=500_000)


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation is a reply tree of one path: the parent of a turn is the turn before it."""
    said = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    said = said.union(spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], said.schema))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = said.select(F.col("conv_id").alias("tree_id"), number.alias("message_id"), "role", "text", F.lit(0.0).alias("score"))
    messages = messages.withColumn("parent_id", F.col("message_id") - 1)
    return chat.read_back(chat.format_trees(messages), ["tree_id"]).withColumnRenamed("tree_id", "conv_id")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", is_held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(docs, langid.train(docs.where("not held_out")), ["doc_id", "held_out"])


def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_components(table(spark, folder, "documents"), shingle=4, radius=4)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, folder, "labels").where(~is_held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score(docs, toxicity.train(docs, labels), ["doc_id", "held_out"])


def op11_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), most=8, scale=1024, offset=100_000)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"), shortest=7, least=2, times=10, one_in=31)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_url_filter": op4_url_filter,
    "op5_media": op5_media,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_language_id": op8_language_id,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_neighbours": op11_neighbours,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
""",
    "op1_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words WHERE len(ws) >= 20
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM starts
), covered AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE r > 1) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
         CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(js, j)), lambda j: ws[j]) END AS ks
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
""",
}
