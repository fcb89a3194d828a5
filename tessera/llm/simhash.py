"""SimHash near-duplicate detection by segment popcounts (operator 9).

A 64-bit fingerprint is embedded as 32 bit counts, one for each segment of two bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so it is a lower
bound. The vectors are laid on grids: the segments form `groups` coordinate groups, and two vectors at a
Manhattan distance of at most `radius` agree on at least groups - radius of them. Every choice of that many
groups spans one grid; a fingerprint has one cell in each, and each near pair shares a cell in some grid.
Rows that share a cell are compared: first by the Manhattan bound, then by the exact Hamming distance.
A cell gives its spanning links, not all its pairs. Cells of more than `chunk` rows are cut into pairs of
chunks, so no task ever holds a whole hot cell.

Near copies of a stated Jaccard similarity are partly further apart than that: near_copies takes the pairs of this search
over fingerprints of short shingles first, and has an exact way for the rest; whole sets of shingles are compared either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, byte_texts, forget, parts, written

ODD = 0x5555555555555555
BROADCAST_IDS = 1_000_000
#: Words of a shingle of the fingerprints by which near_copies searches: an edited word changes few of them.
FINGERPRINT_WORDS = 2


def word_shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by one space; a shorter text is one shingle, no words give none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(shingles: list[bytes], lanes: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); none give 0. Further lanes take the bits
    of hashes of that hash."""
    if not shingles:
        return [0] * lanes
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    out = []
    for _ in range(lanes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)
        out.append(int(np.packbits(ones, bitorder="little").view(np.uint64)[0]))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return out


def lane_names(lanes: int) -> list[str]:
    return ["fp", *[f"fp{i}" for i in range(1, lanes)]]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, lanes: int = 1) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long; fp1, ... for further lanes), one row for each row of docs.

    Letters A-Z are lower-cased, words are runs of bytes other than ASCII white space. Null, empty and blank
    texts have the fingerprint 0. Repeated rows stay repeated; other columns are not read.
    """
    names = lane_names(lanes)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [fingerprint(word_shingles(x.lower().split(), shingle) if x else [], lanes) for x in byte_texts(batch.column(1))]
            prints = np.array(found, np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(prints[:, i]) for i in range(lanes)]], names=["doc_id", *names])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(of_batches, ", ".join(f"{n} long" for n in ["doc_id", *names]))


def segment_counts(fp: Column) -> Column:
    """The 32 bit counts, two bits each, in one long (without carries, so nothing overflows)."""
    left, odd = F.shiftrightunsigned(fp, 1), F.lit(ODD)
    return fp.bitwiseXOR(left).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(left).bitwiseAND(odd), 1))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grid_cells(fps: DataFrame, radius: int, groups: int) -> DataFrame:
    """cell and all columns of fps: the cell of each fingerprint in every grid."""
    if not radius < groups <= 32:
        raise ValueError("groups must exceed radius and be at most 32")
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(edges, edges[1:], strict=False)]
    counts = segment_counts(F.col("fp"))
    cells = []
    for chosen in combinations(range(groups), groups - radius):
        mask = sum(masks[g] for g in chosen)
        cells.append(F.xxhash64(F.lit(len(cells)), counts.bitwiseAND(F.lit(signed(mask)))))
    return fps.select(F.explode(F.array(*cells)).alias("cell"), *fps.columns)


def spread_hot_cells(cells: DataFrame, chunk: int) -> DataFrame:
    """Cells of over `chunk` rows become one cell for each pair of chunks, so that each pair of rows still
    meets and no cell holds more than about two chunks."""
    hot = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk), "hot-cells")
    if hot.isEmpty():
        return cells
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), chunks)
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - F.lit(1).cast("long"))))
    names = [c for c in cells.columns if c != "cell"]
    dealt = cells.join(hot, "cell", "left").select("cell", *names, own.alias("own"), other.alias("other"))
    key = F.when(F.col("other") < 0, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select(key.alias("cell"), *names)


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]; a root is the smallest index of its set."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def near_links(cell: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of spanning links between near rows of each run of equal cells. prints: rows of unsigned lanes."""
    odd, one = np.uint64(ODD), np.uint64(1)
    left = prints[:, 0] >> one
    counts = ((prints[:, 0] ^ left) & odd) | ((prints[:, 0] & left & odd) << one)
    root = np.arange(len(prints))
    at = np.arange(len(prints))
    step = 1
    while len(at := at[at + step < len(prints)]) and len(at := at[cell[at] == cell[at + step]]):
        away = counts[at] ^ counts[at + step]
        bound = np.bitwise_count(away & odd).astype(np.int16) + 2 * np.bitwise_count((away >> one) & odd & ~away).astype(np.int16)
        near = at[bound <= radius]
        distance = np.zeros(len(near), np.int16)
        for lane in range(prints.shape[1]):
            distance += np.bitwise_count(prints[near, lane] ^ prints[near + step, lane])
            near, distance = near[distance <= radius], distance[distance <= radius]
        if len(near):
            root = _merged(root, near, near + step)
        step += 1
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return moved, root[moved]


def cell_links(cells: DataFrame, radius: int, chunk: int) -> DataFrame:
    """a, b: spanning links between near nodes. cells: cell, node and the lanes of the fingerprint."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = near_links(rows[0], np.stack(rows[2:], axis=1).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[1][a]), pa.array(rows[1][b])], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)] if held else new
            ready = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last run may go on
            if ready:
                yield linked([c[:ready] for c in held])
                held = [c[ready:] for c in held]
        if held and len(held[0]):
            yield linked(held)

    return spread_hot_cells(cells, chunk).repartition("cell").sortWithinPartitions("cell").mapInArrow(of_batches, "a long, b long").distinct()


def enough_groups(rows: int, radius: int) -> int:
    """The fewest groups by which a cell holds some eight rows by chance. A cell fixes all but `radius` of the groups of
    32 segments, whose counts 0, 1, 2 are worth one and a half bits each. More groups mean more grids, and no group
    number loses a pair."""
    return next((g for g in range(radius + 2, 32) if rows <= 8 * 2 ** (48 * (g - radius) / g)), 32)


def near_pairs(fps: DataFrame, radius: int = 4, groups: int | None = None, chunk: int = 4096) -> DataFrame:
    """a, b: links between different fingerprints at most `radius` bits apart, enough of them that linked
    fingerprints are connected exactly as by all such pairs. fps: column fp; repeats count once, null is left out.
    groups: see enough_groups, which chooses them from the number of fingerprints.
    """
    nodes = fps.where("fp is not null").select("fp").distinct().select(F.col("fp").alias("node"), "fp")
    if groups is None:
        nodes = written(nodes, "nodes")
        groups = enough_groups(nodes.count(), radius)
    return cell_links(grid_cells(nodes, radius, groups), radius, chunk)


def connected(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of pairs (a, b).

    Alternating large-star and small-star steps, each a grouped minimum and a join on Spark; the pairs are written
    to the shared folder after each round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(pairs.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(edges.select("v", "v")).distinct()
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, groups: int | None = None, chunk: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most
    `radius` differing bits.

    One row for each row of docs. Equal fingerprints always share a component. A null doc_id keeps its row; its
    component_id is null only if no row of its component has an id. An empty table gives no rows.
    """
    marks = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    least = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(near_pairs(least, radius, groups, chunk))
    placed = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marks.join(named, "fp").select("doc_id", hexed, "component_id")


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the shingles of a text, in ascending order."""
    shingles = word_shingles(text.lower().split(), size) if text else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)))


def common_shingles(docs: DataFrame, doc_id: str, text: str, size: int, sample: int = 10_000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the most frequent shingles of about `sample` rows, and their counts."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts(batches):
            found = [shingle_hashes(x, size) for x in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64))], names=["shingle"])

    rows = bounded_sample(docs.where(F.col(doc_id).isNotNull()), doc_id, sample).select(text).mapInArrow(of_batches, "shingle long")
    found = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    keys, counts = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of n to 2n buckets of hashes, a power of two and 512 at least, whether it holds an odd number; 64 a word."""
    bits = max(512, 1 << len(shingles).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other: never more than their
    sets differ in shingles."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def shingle_prefixes(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the set of shingles), fp (the fingerprint of the text's FINGERPRINT_WORDS-word
    shingles), size (the number of shingles), sketch (see parity_sketch), prefix: the shingles of which two sets share one if their Jaccard similarity is `percent` / 100 or more. Rows without an id are
    left out.

    Sets of n shingles in one order for all, of which ceil(percent * n / 100) must be shared, share one of the first
    n - ceil(percent * n / 100) + 1. Any order will do; the shingles frequent in a sample come last, so that few
    sets share a prefix by chance.
    """
    common, counts = common_shingles(docs, doc_id, text, shingle)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts(batches):
            nodes, prints, sizes, sketches, prefixes = [], [], [], [], []
            for x in byte_texts(batch.column(2)):
                prints += fingerprint(word_shingles(x.lower().split(), FINGERPRINT_WORDS) if x else [])
                found = shingle_hashes(x, shingle)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                sizes.append(len(found))
                sketches.append(parity_sketch(found))
                if len(common) and len(found):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
                prefixes.append(found[: len(found) + percent * -len(found) // 100 + 1])
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            columns = [batch.column(0), batch.column(1), *hashes, pa.array(sizes, pa.int64()), *map(long_lists, (sketches, prefixes))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "fp", "size", "sketch", "prefix"])

    return keyed(docs, doc_id, text).mapInArrow(of_batches, "doc_id long, text_key long, node long, fp long, size long, sketch array<long>, prefix array<long>")


def long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of unsigned numbers as lists of longs."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows or [np.empty(0, np.uint64)]).view(np.int64)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key (a hash of the text), text of the rows with an id."""
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """node, shingles: the set of each wanted node (node, doc_id, text_key), once for each row of its text."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts(batches, 100):
            found = [shingle_hashes(x, size) for x in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), long_lists(found)], names=["node", "shingles"])

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = keyed(docs, doc_id, text).join(wanted, ["doc_id", "text_key"]).select("node", "text")
    return rows.mapInArrow(of_batches, "node long, shingles array<long>")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of `percent` / 100 or more. Pairs whose sketches
    differ in more bits than the sets of such a pair can in shingles go first; of the others the whole sets are compared."""

    def near_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            sketches = [[np.frombuffer(np.array(x, np.int64), np.uint64) for x in batch.column(i).to_pylist()] for i in (4, 5)]
            apart = np.array([sketch_distance(x, y) for x, y in zip(*sketches, strict=True)], np.int64)
            yield batch.filter(pa.array(apart * (100 + percent) <= sizes * (100 - percent))).select(["a", "b"])

    left, right = (nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "sketch")]) for x in "ab")
    both = pairs.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b"))
    maybe = written(both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(near_sketches, "a long, b long"), "maybe")
    named = maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(nodes.join(named, "node", "left_semi").select("node", "doc_id", "text_key"), "wanted")
    sets = written(shingle_sets(docs, wanted, doc_id, text, shingle), "sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))  # pair by pair inside Spark: no batch of whole sets is held
    return maybe.join(left, "a").join(right, "b").where(shared * (100 + percent) >= (F.size("of_a") + F.size("of_b")) * percent).select("a", "b")


#: Words of the short sketches that go with the rows of cells.
SHORT_WORDS = 4


def short_sketch(sketch: Column) -> list[Column]:
    """s0, s1, ...: the sketch folded to SHORT_WORDS words, which differ in no more bits than the whole ones."""
    return [F.aggregate(F.filter(sketch, kept_word(i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias(f"s{i}") for i in range(SHORT_WORDS)]


def kept_word(i: int) -> Callable[[Column, Column], Column]:
    return lambda x, at: F.pmod(at, F.lit(SHORT_WORDS)) == i


def fingerprint_pairs(nodes: DataFrame, radius: int, chunk: int) -> DataFrame:
    """a, b: pairs of nodes (node, fp) by which those are connected whose fingerprints are at most `radius` bits apart,
    as near_pairs finds them by segment popcounts; equal fingerprints are connected through their smallest node."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    left, right = (least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(f"least_{x}")) for x in "ab")
    near = near_pairs(least, radius, chunk=chunk).join(left, F.col("a") == F.col("fp_a")).join(right, F.col("b") == F.col("fp_b")).select("least_a", "least_b")
    equal = nodes.select("node", "fp").join(least, "fp").where("node <> least").select("node", "least")
    pairs = near.union(equal).toDF("x", "y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def with_roots(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """cells with the root of each node: itself, if it is not among roots (node, root)."""
    known = roots.withColumnRenamed("node", "linked")
    return cells.join(known, F.col("node") == F.col("linked"), "left").select(*cells.columns, F.coalesce("root", "node").alias("root"))


def similar_roots(cells: DataFrame, nodes: DataFrame, links: DataFrame, similar: Callable[[DataFrame], DataFrame], percent: int, chunk: int) -> DataFrame:
    """node, root of all nodes that are connected by links (a, b) or by similar pairs in a cell. cells: cell, node, size, pos
    (the cell's place in the node's order), rows (the cell's). nodes: node, sketch. What links connect does not meet again.

    A pair counts in the cell that is its first shared shingle: what the two sets share lies there and behind, so the
    shorter of the two rests must be long enough for the similarity. Any similar pair passes in its first cell; pairs
    that share only what is frequent, and so stands last, pass in none.

    The rows of a cell first meet its most central one, whose own cells have most rows: the least edited copy of a text is
    like most of the others, so nearly all of a large group is connected by a pair for each row. Then what is in one cell
    and not yet connected meets; short sketches, which settle nearly all pairs that are not similar, are part of that join.
    """

    def linked(met: DataFrame) -> DataFrame:
        rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
        alike = rest * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent
        pairs = met.where(alike).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        return written(similar(written(pairs, "pairs")), "links")

    columns = ("node", "size", "pos", "root")
    roots = written(connected(links), "roots")
    central = cells.groupBy("node").agg(F.sum("rows").alias("central"))
    best = F.max(F.struct("central", *columns)).alias("best")
    rooted = with_roots(cells, roots)
    pivots = written(rooted.join(central, "node").groupBy("cell").agg(best).select("cell", *[F.col(f"best.{c}").alias(f"{c}_b") for c in columns]), "pivots")
    a = rooted.select("cell", *[F.col(c).alias(f"{c}_a") for c in columns])
    found = linked(a.join(pivots, "cell").where("root_a <> root_b"))
    if not found.isEmpty():
        roots = written(connected(found.union(roots)), "roots")  # what is connected goes in as a star for each root

    open_cells = with_roots(cells, roots).select("cell", *columns)
    several = open_cells.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    open_cells = open_cells.join(several, "cell", "left_semi").join(nodes.select("node", *short_sketch(F.col("sketch"))), "node")
    spread = spread_hot_cells(written(open_cells, "open-cells"), chunk)
    words = [f"s{i}" for i in range(SHORT_WORDS)]
    a, b = (spread.select("cell", *[F.col(c).alias(f"{c}_{x}") for c in (*columns, *words)]) for x in "ab")
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    near = apart * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    found = linked(a.join(b, "cell").where("root_a < root_b").where(near))
    if found.isEmpty():
        return roots
    return written(connected(found.union(roots)), "roots")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, radius: int = 4, chunk: int = 4096) -> DataFrame:
    """doc_id, text_key, root: one row for each row of docs with an id. Rows have the same root if they are connected
    by pairs of texts whose sets of shingles (runs of `shingle` words, compared by XXH64) have a Jaccard similarity of
    `percent` / 100 or more, and only then. Texts without words are alike.

    The first pairs are those of operator 9: SimHash fingerprints, segment popcounts on grids, the Manhattan bound, at most
    `radius` bits of Hamming distance. Similar sets may be further apart than any radius, so what is not yet connected then
    meets where it shares a shingle of its prefix, which loses no pair. Every pair is checked by its whole sets.
    """
    marks = written(shingle_prefixes(docs, doc_id, text, shingle, percent), "prefixes")
    least = F.min(F.struct("doc_id", "text_key")).alias("row")
    rows = written(marks.groupBy("node").agg(least).select("node", "row.*"), "rows")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    own = marks.join(rows, ["node", "doc_id", "text_key"], "left_semi")
    nodes = written(own.select("node", "doc_id", "text_key", "fp", "size", "sketch").dropDuplicates(["node"]), "nodes")
    cells = own.select(F.posexplode("prefix").alias("pos", "cell"), "node", "size").select("cell", "node", "size", "pos")
    sizes = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "cell-sizes")
    cells = written(cells.join(sizes, "cell"), "cells")
    similar = partial(similar_pairs, nodes=nodes, docs=docs, doc_id=doc_id, text=text, shingle=shingle, percent=percent)
    links = written(similar(written(fingerprint_pairs(nodes, radius, chunk), "near-fingerprints")), "near-links")
    roots = similar_roots(cells, nodes, links, similar, percent, chunk).withColumnRenamed("node", "linked")
    return marks.join(roots, F.col("node") == F.col("linked"), "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def wide_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **search: int) -> DataFrame:
    """doc_id, component_id: the smallest doc_id of the near copies (see near_copies). Rows without an id are left out."""
    rows = written(near_copies(docs, doc_id, text, **search), "near-copies")
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **search: int) -> DataFrame:
    """The rows of docs, all columns, that are the smallest by doc_id of their near copies (see near_copies).

    Rows go one by one: of rows that share a doc_id those whose texts are no near copies all stay, and of rows that
    share a doc_id and the text one stays. Rows without an id all stay: nothing names them.
    """
    rows = written(near_copies(docs, doc_id, text, **search), "near-copies")
    own = F.struct("doc_id", "text_key")
    best = rows.groupBy("root").agg(F.min(own).alias("best"))
    gone = unclaimed(docs, "gone_id", "gone_key")
    goes = rows.join(best, "root").where(own != F.col("best")).select(*[F.col(c).alias(g) for c, g in zip(("doc_id", "text_key"), gone, strict=True)]).distinct()
    goes = written(goes, "gone")
    if goes.count() <= BROADCAST_IDS:  # few megabytes; beyond that the texts are shuffled
        goes = F.broadcast(goes)
    kept = docs.join(goes, (F.col(doc_id).cast("long") == F.col(gone[0])) & (F.xxhash64(text) == F.col(gone[1])), "left_anti")
    if not rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        order = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(text)
        (place,) = unclaimed(docs, "place")
        kept = kept.withColumn(place, F.when(F.col(doc_id).isNull(), 1).otherwise(F.row_number().over(order))).where(F.col(place) == 1).drop(place)
    return kept


def unclaimed(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of df needs."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
