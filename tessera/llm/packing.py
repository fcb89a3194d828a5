"""Packing (operator 6): cutting-stock column generation.

Every document becomes token ids and a closing id, cut into pieces of `capacity` ids and one shorter tail. The piece
lengths' histogram, at most `capacity` numbers, goes to the driver. There a linear program over patterns (how many
pieces of each length fill a sequence) is solved by column generation; an unbounded-knapsack dynamic program prices new
patterns. Patterns that fill a sequence exactly are used as often as the program says, rounded down. The pieces of one
length are ranked over all documents, and arithmetic on the rank places each piece, so no group is ever gathered.
What the rounded patterns leave over is laid end to end and cut at sequence ends; the last, partial sequence is cut
into powers of two. No sequence holds padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import CLEARED, give_back, parts, written

#: Before a single space between two visible characters the tokenizer always starts a new word.
WORD_START = re.compile(r"(?<=\S)(?= \S)")
#: It does so before any space, but for one between white space or at the end after white space.
NO_START = re.compile(r"\s (?!\S)")
#: Words on whose parts the pattern's and the tokenizer's own Unicode tables can't differ.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f]{1,64}")
#: A word of letters and a run of these has two parts.
MARKS = ".,;:!?|%*&$#"
#: Words kept in each of two generations, of some 200 bytes each.
CACHED_WORDS = 150_000
#: Slots, by a hash, that tell which words have come before.
CAME_SLOTS = 1 << 20
BROADCAST_ROWS = 50_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the tokenizer's words: itself if it is visible, else one beyond."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


class WordIds(dict[str, bytes]):
    """Texts -> the ids of the tokenizer file's plain encoding, as little-endian 32-bit numbers.

    Texts are cut into words, words into the pattern's parts, and the tokenizer's model gives the ids of a part. The
    words in use are this dictionary and an older one that goes when the newer is full; a word that isn't letters alone
    is remembered when it comes again, as most never do. Long words and those with characters beyond the Latin ones are
    left to the whole tokenizer, and so are texts that hold one of its added tokens.
    """

    def __init__(self, path: str, pattern: str, cached_words: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.n_ids = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts_of, self.characters = regex.compile(pattern).findall, byte_characters()
        self.plain_runs = self.parts_of(f" a{MARKS}\nb{MARKS}\nc") == [" a", MARKS, "\n", "b", MARKS, "\n", "c"]
        self.cached_words = cached_words
        self.marks: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.came = bytearray(CAME_SLOTS)
        self.blank = False

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        spelled = part.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def letters(self, word: str) -> bytes:
        """The ids of a word of letters alone and the space before it."""
        if not word.isascii():
            return self.part(" " + word)
        return array("I", [t.id for t in self.model.tokenize(self.characters[32] + word)]).tobytes()

    def cut(self, word: str) -> list[str]:
        """The parts of a word, the first without the space before it."""
        line, end, rest = word.partition("\n")
        first, second = line.rstrip(MARKS), rest.rstrip(MARKS)
        if self.plain_runs and first.isalpha() and (second.isalpha() or not end):
            return [p for p in (first, line[len(first) :], end, second, rest[len(second) :]) if p]
        first, *others = self.parts_of(" " + word)
        return [first[1:], *others]

    def solve(self, word: str) -> tuple[bytes, bool]:
        """The ids of a word and the space before it; whether to remember it."""
        if not (word.isascii() and len(word) <= 64) and not PLAIN.fullmatch(word):
            return self.whole(" " + word), len(word) <= 64
        if word.isalpha():
            return self.letters(word), True
        first, *others = self.cut(word)
        start = self[first] if first.isalpha() else self.part(" " + first)
        slot = hash(word) % CAME_SLOTS
        again, self.came[slot] = self.came[slot], 1
        return start + b"".join(map(self.remembered_mark, others)), again > 0

    def remembered_mark(self, part: str) -> bytes:
        """The ids of a part without a space before it."""
        if part not in self.marks:
            if len(self.marks) >= self.cached_words:
                self.marks.clear()
            self.marks[part] = self.part(part)
        return self.marks[part]

    def __missing__(self, word: str) -> bytes:
        ids, keep = self.before.get(word), True
        if not ids:
            ids, keep = self.solve(word)
        if not word[:1].strip():  # never remembered, so that every text with such a word comes here
            self.blank, keep = True, False
        if keep:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) >= self.cached_words:
            self.before = dict(self)
            self.clear()
            self.came = bytearray(CAME_SLOTS)
        if any(token in text for token in self.added):
            return self.whole(text)
        self.blank = False
        words = text.split(" ")
        ids = self.whole(words.pop(0)) + b"".join(map(self.__getitem__, words))
        if self.blank and NO_START.search(text):
            first, *others = WORD_START.split(text)
            ids = self.whole(first) + b"".join([self[w[1:]] for w in others])
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str, pattern: str, cached_words: int = CACHED_WORDS) -> WordIds:
    """One for each tokenizer and Python worker, with the words that it has encoded."""
    return WordIds(path, pattern, cached_words)


CLEARED.append(word_ids.cache_clear)


def tokenized(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, closing_id: int, doc_id: str, text: str, cached_words: int) -> DataFrame:
    """doc_id, doc_tokens, crcs (of each piece), tail (the ids of a last piece that is shorter, two bytes each where they fit)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = word_ids(tokenizer, pattern, cached_words)
        kind = np.uint16 if max(words.n_ids, closing_id + 1) <= 1 << 16 else np.uint32
        closing = np.array([closing_id], "<u4").tobytes()
        for batch in parts(batches):
            sizes, crcs, tails = [], [], []
            for value in batch.column(1).to_pylist():
                ids = (words.of(value) if value else b"") + closing
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[k : k + 4 * capacity]) for k in range(0, len(ids), 4 * capacity)])
                rest = len(ids) % (4 * capacity)
                tails.append(np.frombuffer(ids[len(ids) - rest :], "<u4").astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], names=["doc_id", "doc_tokens", "crcs", "tail"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(of_batches, "doc_id long, doc_tokens long, crcs array<long>, tail binary")


def best_fills(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: of each size up to capacity, the highest worth and the last item taken (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for size in range(1, capacity + 1):
        fitting = np.searchsorted(lengths, size, side="right")
        best[size], last[size] = best[size - 1], -1
        if fitting:
            totals = best[size - lengths[:fitting]] + worth[:fitting]
            k = int(np.argmax(totals))
            if totals[k] > best[size] + 1e-12:
                best[size], last[size] = totals[k], k
    return best, last


def _pattern(lengths: np.ndarray, best: np.ndarray, last: np.ndarray, size: int, first: int) -> np.ndarray:
    """The best pattern that holds item `first`."""
    out = np.zeros(len(lengths))
    out[first] += 1
    size -= lengths[first]
    while size > 0:
        if last[size] < 0:
            size -= 1
        else:
            out[last[size]] += 1
            size -= lengths[last[size]]
    return out


def first_basis(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a feasible basis, and its inverse: two lengths that make up a sequence share one pattern; the more
    frequent of the two, and any length without such a partner, has a pattern of its own."""
    most = np.floor(capacity / lengths)
    basis, inverse = np.diag(most), np.diag(1 / most)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    for length, i in place.items():
        k = place.get(capacity - length)
        if k is not None and i < k:
            few, many = (i, k) if counts[i] <= counts[k] else (k, i)
            basis[:, few] = 0
            basis[[i, k], few] = 1
            inverse[few, few], inverse[many, few] = 1, -1 / most[many]
    return basis, inverse


def solve_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.002, most_rounds: int = 120, at_once: int = 24) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is used, fractions allowed, to use exactly `counts` pieces of `lengths`, and the
    gap that is proven.

    Revised simplex. It ends when Farley's bound proves the number of sequences to be within `gap` of the optimum, or
    after `most_rounds` pricings; the gap then says how far off it may be. Either way every piece is packed: what the
    patterns leave over is laid end to end.
    """
    basis, inverse = first_basis(lengths, counts, capacity)
    used = (inverse * counts).sum(axis=1)
    dual = inverse.sum(axis=0)
    reached = float("inf")
    for _ in range(most_rounds):
        best, last = best_fills(lengths, dual, capacity)
        reached = best[capacity] - 1
        if reached <= gap:
            break
        gains = dual + best[capacity - lengths]
        entered = 0
        for first in np.argsort(-gains)[:at_once]:
            column = _pattern(lengths, best, last, capacity, int(first))
            if (gain := dual @ column - 1) <= gap / 2:
                continue
            held = np.flatnonzero(column)
            direction = (inverse[:, held] * column[held]).sum(axis=1)
            rising = np.flatnonzero(direction > 1e-9)
            if not len(rising):
                continue
            out = rising[np.argmin(used[rising] / direction[rising])]
            times = used[out] / direction[out]
            used -= times * direction
            used[out] = times
            pivot = inverse[out] / direction[out]
            changed = np.flatnonzero(np.abs(direction) > 1e-12)
            inverse[changed] -= np.outer(direction[changed], pivot)
            inverse[out] = pivot
            basis[:, out] = column
            dual = dual - gain * pivot
            entered += 1
        if not entered:
            break
    return basis.T, np.clip(used, 0, None), float(reached)


@dataclass(frozen=True)
class Plan:
    """places: length, from_rank, to_rank, copies, sequence, offset. stream: length, from_rank, position.
    The stream of stream_tokens ids starts at sequence stream_sequence. gap: see solve_patterns."""

    places: list[tuple]
    stream: list[tuple]
    stream_sequence: int
    stream_tokens: int
    stream_pieces: int
    gap: float


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    sequences = histogram.get(capacity, 0)
    places = [(capacity, 0, sequences, 1, 0, 0)] if sequences else []
    lengths = np.array(sorted(k for k in histogram if k < capacity), np.int64)
    taken, gap = dict.fromkeys(lengths.tolist(), 0), 0.0
    if len(lengths):
        counts = np.array([histogram[k] for k in lengths.tolist()], float)
        patterns, times_used, gap = solve_patterns(lengths, counts, capacity)
        for pattern, used in zip(patterns, times_used, strict=True):
            copies = pattern.astype(np.int64)
            times = min([int(used + 1e-7), *((histogram[n] - taken[n]) // c for n, c in zip(lengths.tolist(), copies.tolist(), strict=True) if c)])
            if times <= 0 or int(copies @ lengths) != capacity:
                continue
            offset = 0
            for k in np.flatnonzero(copies).tolist():
                length, c = int(lengths[k]), int(copies[k])
                places.append((length, taken[length], taken[length] + times * c, c, sequences, offset))
                taken[length] += times * c
                offset += c * length
            sequences += times
    stream, position, pieces = [], 0, 0
    for length, done in taken.items():
        if left := histogram[length] - done:
            stream.append((length, done, position))
            position += left * length
            pieces += left
    return Plan(places, stream, sequences, position, pieces, gap)


def stream_ends(tokens: int, capacity: int) -> list[int]:
    """Where the sequences of the stream's last, partial stretch end: powers of two."""
    at, rest, ends = tokens - tokens % capacity, tokens % capacity, []
    for bit in reversed(range(capacity.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 1024, closing_id: int = 0, doc_id: str = "doc_id", text: str = "text", slice_rows: int = 4096, cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each document.

    A document's ids are those of its text (null: empty) and closing_id. tokenizer, pattern: a tokenizer
    file and the expression that splits its words, see WordIds. Each id lies in exactly one piece; the
    pieces of a sequence follow each other from offset 0; a sequence is full or a power of two long. Repeated rows
    are documents of their own; a null doc_id stays null. An empty table gives no rows. capacity: a power of two.
    cached_words: how many words a Python worker remembers, twice; more cost memory and save time, results are the same.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    found = tokenized(docs, tokenizer, pattern, capacity, closing_id, doc_id, text, cached_words)
    documents = written(found.withColumn("row_id", F.monotonically_increasing_id()), "tokens")
    length = F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("piece") * capacity)
    pieces = documents.select("row_id", "doc_id", "doc_tokens", F.posexplode("crcs").alias("piece", "ids_crc32")).withColumn("length", length)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, capacity)

    slices = max(1, sum(histogram.values()) // slice_rows)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("row_id", "piece"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    own = F.row_number().over(Window.partitionBy("slice", "length").orderBy("doc_id", "row_id", "piece"))
    ranked = sliced.withColumn("own_rank", own).join(starts, ["length", "slice"]).withColumn("rank", F.col("first_rank") + F.col("own_rank") - 1)

    # One row for each length of each pattern: at most capacity patterns, so the size is bounded.
    places = spark.createDataFrame(plan.places, "p_length long, from_rank long, to_rank long, copies long, p_sequence long, p_offset long")
    inside = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    turn = F.col("rank") - F.col("from_rank")
    placed = ranked.join(F.broadcast(places), inside).select(
        "doc_id", (F.col("piece") * F.lit(capacity).cast("long")).alias("start"), "length", "ids_crc32", "doc_tokens",
        (F.col("p_sequence") + F.floor(turn / F.col("copies"))).alias("sequence_id"), (F.col("p_offset") + turn % F.col("copies") * F.col("length")).alias("offset"),
    )
    if not plan.stream:
        return placed

    laid = spark.createDataFrame(plan.stream, "s_length long, s_rank long, s_position long")
    over = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank"))
    position = F.col("s_position") + (F.col("rank") - F.col("s_rank")) * F.col("length")
    rest = ranked.join(F.broadcast(laid), over).select("row_id", "piece", position.alias("position"))
    rest = F.broadcast(rest) if plan.stream_pieces <= BROADCAST_ROWS else rest
    tails = documents.select("row_id", "doc_id", "doc_tokens", "tail").join(rest, "row_id").drop("row_id")
    whole, ends, base = plan.stream_tokens // capacity * capacity, stream_ends(plan.stream_tokens, capacity), plan.stream_sequence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                count = row["doc_tokens"] - row["piece"] * capacity
                ids = np.frombuffer(row["tail"], np.uint16 if len(row["tail"]) == 2 * count else np.uint32).astype("<u4").tobytes()
                begin = at = row["position"]
                while at < begin + count:
                    if at < whole:
                        number, first, end = at // capacity, at // capacity * capacity, (at // capacity + 1) * capacity
                    else:
                        k = next(i for i, e in enumerate(ends) if at < e)
                        number, first, end = whole // capacity + k, ends[k - 1] if k else whole, ends[k]
                    stop = min(end, begin + count)
                    crc = zlib.crc32(ids[4 * (at - begin) : 4 * (stop - begin)])
                    for column, value in zip(out, (row["doc_id"], row["piece"] * capacity + at - begin, stop - at, crc, row["doc_tokens"], base + number, at - first), strict=True):
                        column.append(value)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.union(tails.mapInArrow(cut, schema))
