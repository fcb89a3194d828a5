"""Language ID (operator 8): language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each position holds a bit mask, and the masks at an n-gram's
positions, and-ed, are the languages that contain it. A text's n-grams are counted for each language; the counts are
corrected for the filter's false positives and the largest decides.

Training reads a bounded sample of labelled rows (`rows_per_language`, by a hash of the id). An n-gram belongs to a
language if it is in at least `min_share` of the language's documents and in at least `min_ratio` of the share of the
language that has it most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.grams import text_hashes
from tessera.llm.shared import forget, kept, kept_schema, parts, rows_where

ORDERS = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Filters:
    """languages in bit order, the masks (a power of two of positions), the share of false positives of each."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false_share: np.ndarray

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Of each language, the corrected number of the n-grams that it contains."""
        first, second = positions(grams, len(self.masks))
        held = self.masks[first] & self.masks[second]
        raw = np.array([np.count_nonzero(held & self.masks.dtype.type(1 << bit)) for bit in range(len(self.languages))], float)
        return np.clip((raw - len(grams) * self.false_share) / (1 - self.false_share), 0, None)

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and the share of the text's n-grams that it contains."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        grams = text_hashes(text, ORDERS)
        counts = self.counts(grams)
        best = int(np.argmax(counts))  # ties: the first in alphabetical order
        return self.languages[best], float(min(1.0, counts[best] / len(grams)))


def positions(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - (size.bit_length() - 1))
    return (grams * np.uint32(0x85EBCA6B)) >> shift, ((grams ^ (grams >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, documents: partial counts, given out whenever a few million n-grams have gathered."""
    forget()
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for lang, found in sorted(held.items()):
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "gram", "documents"])

    for batch in parts(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = np.unique(text_hashes(text or "", ORDERS))
            held.setdefault(lang, []).append(grams)
            size += len(grams)
            if size > 4_000_000:
                yield from given()
                held, size = {}, 0
    yield from given()


def train(labelled: DataFrame, rows_per_language: int = 2000, min_share: float = 0.01, min_ratio: float = 0.2, log_positions: int = 20) -> Filters:
    """labelled: doc_id, text, lang. Rows without lang or id are left out; repeated rows count again; at most 64
    languages. An empty table gives filters that know no language.

    All n-grams that belong to a language go to the driver: for each language at most the mean number of distinct
    n-grams of its sampled documents over min_share. The filter has 2**log_positions positions, or as many more as keep
    it at an eighth.
    """
    labelled = labelled.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if len(languages) > 64:
        raise ValueError("a language bitmask holds at most 64 languages")
    if not languages:
        return Filters((), np.zeros(1 << log_positions, np.uint64), np.zeros(0))
    rate = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, rows_per_language / sizes[lang]) * (1 << 30))))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")))
    n = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = sample.select("lang", "text").mapInArrow(_document_counts, "lang string, gram int, documents long")
    total = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(float(n.get(lang, 1))))])
    shares = counted.groupBy("gram", "lang").agg((F.sum("documents") / F.first(F.element_at(total, F.col("lang")))).alias("share"))
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("found")).where(F.col("top") >= min_share)
    has = F.filter("found", lambda x: (x["share"] >= min_share) & (x["share"] >= min_ratio * F.col("top")))
    kept = by_gram.select("gram", F.transform(has, lambda x: x["lang"]).alias("langs")).toPandas()
    bit = {lang: i for i, lang in enumerate(languages)}
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    masks = np.zeros(1 << max(log_positions, (8 * len(kept)).bit_length()), kind)
    own = np.array([sum(1 << bit[x] for x in langs) for langs in kept["langs"]], np.uint64).astype(kind)
    for at in positions(kept["gram"].to_numpy(np.int32).view(np.uint32), len(masks)):
        np.bitwise_or.at(masks, at, own)
    fill = np.array([np.count_nonzero(masks & kind(1 << i)) / len(masks) for i in range(len(languages))])
    return Filters(languages, masks, fill**2)


def identify(docs: DataFrame, filters: Filters, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, lang_pred and score (0 to 1).

    lang_pred is a learned language, or `und` if the text is null or has no letter. One row for each row of docs,
    repeated ones too; very long texts are read whole; an empty table gives no rows. A kept column with the name of a
    result is called kept_<name>.
    """
    names = [*docs.select(*kept(keep, ["lang_pred", "score"])).columns, "lang_pred", "score"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [filters.decide(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, F.col(text).alias("read_text")).mapInArrow(of_batches, kept_schema(docs, keep, "lang_pred string, score double"))


def in_known_language(docs: DataFrame, filters: Filters, text: str = "text", min_share: float = 0.2) -> DataFrame:
    """The rows of docs, all columns, whose text has letters and at least min_share of whose n-grams its language
    contains. Filters that know no language keep all rows."""

    def keeps(texts: list[str | None]) -> list[bool]:
        return [not filters.languages or (lang != UNKNOWN and share >= min_share) for lang, share in map(filters.decide, texts)]

    return rows_where(docs, text, keeps)
