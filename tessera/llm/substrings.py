"""Substring dedup (operator 1): Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Documents are dealt to blocks by ranges of doc_id, so that block order is document order. The ranges are
   quantiles of doc_id weighted by text length; a block holds about `block_bytes` of text. Ids that hold more, as a
   missing one may, are dealt on by a hash of the text.
2. Each block hashes all its windows and sends every distinct hash once to the bucket its high bits name, packed:
   sorted differences, byte planes, compressed; as flat rows they would need twice the disk. A bucket holds the windows
   of about `bucket_bytes` of text, and a window that a third of all documents share reaches its bucket once for each
   block. There are blocks times buckets packets, so both sizes should grow with a corpus of many terabytes.
3. A bucket counts each hash over all blocks. It answers every block with a bit mask: this hash also occurs in an
   earlier block.
4. The block hashes its windows again, adds those that start earlier within the block, merges the windows that
   repeat into maximal intervals, and cuts these out.

Two windows count as equal when a 64-bit Rabin-Karp hash agrees and 32 bits of a second one, over the two independent
halves of the words' 128-bit XXH3. Different windows agree with a probability of about 2**-96 for each pair.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import byte_texts, forget, give_back, total_bytes

#: Odd multipliers of the two rolling hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
VOCABULARY = 1 << 16


SPACE = re.compile(rb"[\x20\x09-\x0d]")


class WordHashes(dict):
    """Word -> its 128-bit XXH3; forgets all when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = value = xxhash.xxh3_128_digest(word, 42)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two independent hashes of each word."""
        if len(self) > VOCABULARY:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


def pieces(text: bytes | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, a megabyte at a time."""
    at, text = 0, text or b""
    while len(text) - at > size and (space := SPACE.search(text, at + size)):
        yield text[at : space.start()].split()
        at = space.start()
    yield text[at:].split()


def kept_words(text: bytes | None, keep: np.ndarray | None) -> bytes:
    """The words that are kept (all, if keep is None), joined by one space."""
    out, at = [], 0
    for words in pieces(text):
        if keep is not None:
            words, at = list(compress(words, keep[at : at + len(words)].tolist())), at + len(words)
        if words:
            out.append(b" ".join(words))
    return b" ".join(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both Rabin-Karp hashes of all windows of `size` words, by prefix sums modulo 2**64."""
    n = len(words) - size + 1
    out = []
    for lane, base in enumerate(BASES):
        inverse = pow(base, -1, 1 << 64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words[:, lane] * _powers(inverse, len(words)), dtype=np.uint64)))
        key = (sums[size:] - sums[:-size]) * _powers(base, n)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        out.append(key ^ (key >> np.uint64(32)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


class Block:
    """The windows of one block in document order: `key`, `check` of each distinct hash, where it is first."""

    def __init__(self, texts: list[bytes | None], size: int) -> None:
        vocabulary = WordHashes()
        keys, checks, self.counts = [], [], []
        for text in texts:
            words = [vocabulary.of(part) for part in pieces(text)]
            n_words = sum(map(len, words))
            self.counts.append(n_words)
            if n_words >= size:
                key, check = window_hashes(np.concatenate(words), size)
                keys.append(key)
                checks.append(check)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        check = np.concatenate(checks) if checks else np.empty(0, np.uint32)
        order = np.argsort(key)
        key, check = key[order], check[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        if (~new[1:] & (check[1:] != check[:-1])).any():  # one key, different windows
            again = np.lexsort((check, key))
            order, key, check = order[again], key[again], check[again]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
        starts = np.flatnonzero(new)
        self.key, self.check = key[starts], check[starts]
        self.first = np.minimum.reduceat(order, starts) if len(starts) else starts
        self.kind = np.empty(len(order), np.int64)  # of each window, the number of its distinct hash
        self.kind[order] = np.cumsum(new) - 1

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket's hashes begin among the sorted keys."""
        edges = (np.arange(1, buckets, dtype=object) << 64) // buckets
        return np.concatenate(([0], np.searchsorted(self.key, edges.astype(np.uint64)), [len(self.key)]))

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Of each window, whether it also starts earlier. earlier: of each distinct hash, in an earlier block."""
        return earlier[self.kind] | (self.first[self.kind] < np.arange(len(self.kind)))


def pack(key: np.ndarray, check: np.ndarray) -> bytes:
    steps = np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    planes = np.concatenate((steps, check.view(np.uint8).reshape(-1, 4).T))
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(12, -1)
    key = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    return key, np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel()


def keep_mask(repeated: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Of each word, whether no repeated window covers it."""
    change = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(repeated)
    change[at] += 1
    change[at + size] -= 1
    return np.cumsum(change[:-1]) == 0


def with_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs (doc_id, text, others) with text_hash and the number of their block, in document order: rows without id
    first, then by doc_id, of one doc_id by text_hash."""
    n = max(1, -(-total_bytes(docs, "text") // block_bytes))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # Both go to the driver, as the blocks' limits: at most one id for each block.
    heavy = {r["doc_id"]: -(-r["b"] // block_bytes) for r in docs.groupBy("doc_id").agg(F.sum(size).alias("b")).where(F.col("b") > 2 * block_bytes).collect()}
    weighted = docs.where("doc_id is not null").select(F.explode(F.array_repeat("doc_id", 1 + F.floor(size / 4096).cast("int"))).alias("doc_id"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else None
    found = weighted.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("e")).first()["e"] if n > 1 else []
    alone = [x for h in heavy if h is not None for x in (h, h + 1) if x < 1 << 63]
    edges = np.array(sorted({*(found or []), *alone}), np.int64)

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash").to_numpy()
            known = np.asarray(ids.is_valid())
            block = np.where(known, 1 + np.searchsorted(edges, ids.fill_null(0).to_numpy(), side="right"), 0) << 20
            share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
            parts = np.array([heavy.get(i, 1) for i in ids.to_pylist()] if heavy else np.ones(len(hashes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block + np.minimum(share * parts, parts - 1).astype(np.int64))], names=[*batch.schema.names, "block"])

    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(block_of, hashed.withColumn("block", F.lit(0).cast("long")).schema)


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text_hash", "ascending"), ("text", "ascending")], null_placement="at_start"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, block_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text), the columns `keep`, in this order: each document without the words
    that a repeated window covers. kept_text: the text as it was if nothing is removed, else the kept words joined by
    one space; kept_sha256 always is of the words so joined.

    A window is `window` consecutive words; it is repeated if its words also start earlier: in a document with a
    smaller doc_id, or earlier in the same document. Rows with one doc_id are ordered by a hash of their
    text, then by text, and count as documents one after the other; rows without an id come before all others. Null, empty and blank texts have no
    words (kept_text of a null is null); shorter texts have no window and stay whole. One row for each row of docs; an
    empty table gives none. A kept column with the name of a result is called kept_<name>, with as many underscores before
    it as that takes; other columns are not read.
    """
    extra = [f"keep_{i}" for i in range(len(keep))]
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(e) for c, e in zip(keep, extra, strict=True)])
    blocked = with_blocks(plain, block_bytes)
    buckets = max(1, -(-total_bytes(plain, "text") // bucket_bytes))

    def send(table: pa.Table) -> pa.Table:
        forget()
        table = _ordered(table)
        block = Block(byte_texts(table["text"]), window)
        cuts = block.cuts(buckets)
        full = np.flatnonzero(np.diff(cuts))
        packed = [pack(block.key[cuts[b] : cuts[b + 1]], block.check[cuts[b] : cuts[b + 1]]) for b in full]
        number = table["block"][0].as_py()
        del block, table
        give_back()
        return pa.table({"block": pa.array([number] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "packed": pa.array(packed, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        forget()
        blocks = table["block"].to_numpy()
        parts = [unpack(x) for x in table["packed"].to_pylist()]
        sizes = [len(k) for k, _ in parts]
        owner = np.repeat(blocks, sizes)
        key, check = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.lexsort((owner, check, key))
        key, check = key[order], check[order]
        later = np.empty(len(order), bool)
        later[order] = np.concatenate(([False], (key[1:] == key[:-1]) & (check[1:] == check[:-1])))
        ends = np.cumsum(sizes)
        masks = [zlib.compress(np.packbits(later[e - s : e]).tobytes(), 1) for e, s in zip(ends, sizes, strict=True)]
        del parts, owner, key, check, order, later
        give_back()
        return pa.table({"block": table["block"], "bucket": table["bucket"], "mask": pa.array(masks, pa.binary())})

    def cut(own: pa.Table, answers: pa.Table) -> pa.Table:
        forget()
        own = _ordered(own)
        texts = byte_texts(own["text"])
        block = Block(texts, window)
        cuts = block.cuts(buckets)
        earlier = np.zeros(len(block.key), bool)
        for bucket, mask in zip(answers["bucket"].to_pylist(), answers["mask"].to_pylist(), strict=True):
            a, b = cuts[bucket], cuts[bucket + 1]
            earlier[a:b] = np.unpackbits(np.frombuffer(zlib.decompress(mask), np.uint8), count=b - a)
        repeated = block.repeated(earlier)
        removed, digests, kept, at = [], [], [], 0
        counts = block.counts
        for text, n_words in zip(texts, counts, strict=True):
            keep = None
            if n_words >= window:
                windows = repeated[at : at + n_words - window + 1]
                at += len(windows)
                if windows.any():
                    keep = keep_mask(windows, n_words, window)
            joined = kept_words(text, keep)
            removed.append(0 if keep is None else n_words - int(keep.sum()))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(text if keep is None else joined)
        del block, texts, repeated, earlier
        give_back()
        columns = {"doc_id": own["doc_id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests)}
        columns |= {"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}
        return pa.table(columns | {e: own[e] for e in extra})

    sent = blocked.groupBy("block").applyInArrow(send, "block long, bucket int, packed binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "block long, bucket int, mask binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in plain.schema[2:])
    found = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
    results = found.columns[: len(found.columns) - len(keep)]
    return found.select(*results, *[F.col(e).alias(name) for e, name in zip(extra, own_names(keep, results), strict=True)])


def own_names(keep: tuple[str, ...], results: list[str]) -> list[str]:
    """Names of kept columns that no result and no other kept column has."""
    taken, out = {r.lower() for r in results}, []
    for name in keep:
        if name.lower() in taken:
            name = f"kept_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
