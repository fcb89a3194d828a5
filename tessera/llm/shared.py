"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import settled as written

__all__ = ["bounded_sample", "byte_texts", "forget", "give_back", "is_held_out", "kept", "kept_schema", "parts", "rows_where", "total_bytes", "written"]


#: Clears what operators remember from task to task.
CLEARED: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory to the machine. A Python worker outlives its stage, and Arrow and the C library keep for it what
    earlier tasks have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def forget() -> None:
    """Give up what other operators remember in this Python worker, which outlives its stage, and what tasks have freed."""
    for clear in CLEARED:
        clear()
    give_back()


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def kept(keep: list[str], results: list[str]) -> list[Column]:
    """The kept columns; one with the name of a result (in any case) is called kept_<name>."""
    taken = {r.lower() for r in results}
    return [F.col(c).alias(f"kept_{c}" if c.lower() in taken else c) for c in keep]


def kept_schema(df: DataFrame, keep: list[str], results: str) -> str:
    """The DDL of the kept columns of df and the results."""
    names = [x.split()[0] for x in results.split(", ")]
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept(keep, names)).schema], results])


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def bounded_sample(labelled: DataFrame, key: str, max_rows: int, seed: int = 10) -> DataFrame:
    """About `max_rows` rows, chosen by a hash of the key; all, if there are fewer."""
    n = labelled.count()
    if n <= max_rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def rows_where(docs: DataFrame, text: str, keeps: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs, all columns, whose text the function keeps; it is given the texts of one Arrow batch."""
    at = docs.columns.index(text)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts(batches):
            yield batch.filter(pa.array(keeps(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(of_batches, docs.schema)
