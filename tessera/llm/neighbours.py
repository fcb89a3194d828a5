"""Approximate nearest neighbours by inner product, with an adaptive scan of dimensions (operator 11).

Equal vectors are one node with its k + 1 smallest ids: of equal scores no others can be among a query's k. Inner
products become distances by one more component, sqrt(M - |x|**2) for rows (M the largest square) and 0 for queries. A
bounded sample gives the centres of lists by k-means; every node goes to the list of its nearest centre. Lists that lie
together form regions of at most `region_rows` rows, which one task holds; a larger list is cut into several regions.

The index has, for each chunk of a region, its vectors turned by a random rotation and stored in blocks of columns. A
query scans the lists it probes block by block. After d of D turned dimensions, the partial distance times D / d estimates
the whole one; candidates whose estimate exceeds the query's k-th best by more than the test's margin, (1 + 2.1 /
sqrt(d))**2, are abandoned. Those that are left after the last block are scored on the original vectors.

How many lists a query probes is measured: a bounded sample of queries is answered by brute force over all rows, and the
fewest nearest lists that hold the wanted share of its neighbours are probed by all. A query first meets the region of its
nearest list, whose k-th best score is its threshold in the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, written
from tessera.llm.whitening import finite

#: Margin of the test by which candidates are abandoned, in deviations of the estimate.
MARGIN = 2.1
#: Candidates that are compared beyond the first block of columns at a time.
PAIRS = 100_000


def doubles(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of `width` doubles; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order whatever else is in the batch, so equal vectors tie."""
    return np.add.reduce(np.ascontiguousarray(a * b), axis=1)


@dataclass
class Lists:
    """What is fitted on the sample: centres in width + 1 dimensions, the rotation, and the largest square."""

    width: int
    largest: float
    centres: np.ndarray
    rotation: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.zeros((len(x), 1))), axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To all centres, less the square of the row itself."""
        return (self.centres**2).sum(axis=1) - 2 * lifted @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(self.lifted(x)).argmin(axis=1)


def fitted(sample: np.ndarray, largest: float, n_lists: int, rounds: int = 8, seed: int = 11) -> Lists:
    """k-means of the sample, its centres in an order in which neighbours lie together."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    turned, r = np.linalg.qr(rng.standard_normal((width + 1, width + 1)))
    lists = Lists(width, largest, np.zeros((0, width + 1)), turned * np.sign(np.diag(r)))
    rows = lists.lifted(sample)
    lists.centres = rows[rng.choice(len(rows), min(n_lists, len(rows)), replace=False)]
    for _ in range(rounds):
        own = lists.distances(rows).argmin(axis=1)
        sums = np.zeros_like(lists.centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(sums))
        empty = counts == 0
        lists.centres = np.where(empty[:, None], rows[rng.choice(len(rows), len(sums))], sums / np.maximum(counts, 1)[:, None])
    heads = lists.centres[:: max(1, int(len(lists.centres) ** 0.5))]
    order = np.argsort(((heads**2).sum(axis=1) - 2 * lists.centres @ heads.T).argmin(axis=1), kind="stable")
    lists.centres = lists.centres[order]
    return lists


def best_of(query: np.ndarray, node: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, by score and then by the smaller node."""
    order = np.lexsort((node, -score, query))
    own = query[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[place < k]


class Scan:
    """The best k of some queries over lists of one region."""

    def __init__(self, queries: np.ndarray, turned: np.ndarray, floors: np.ndarray, largest: float, k: int) -> None:
        self.queries, self.turned, self.k = queries, turned, k
        self.squares = np.einsum("ij,ij->i", queries, queries)
        self.base, self.floors = largest + self.squares, floors.copy()
        self.query, self.node, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.compared = self.whole = 0

    def reach(self, own: np.ndarray) -> np.ndarray:
        """The largest squared distance at which a row still scores the floor; rounding is allowed for."""
        return np.maximum(self.base[own] - 2 * self.floors[own], 0) + 1e-9 * self.base[own]

    def over(self, own: np.ndarray, nodes: np.ndarray, rows: np.ndarray, blocks: list[np.ndarray]) -> None:
        """Queries `own` over rows of one list; blocks: the same rows turned, some columns each."""
        step = max(1, PAIRS // max(1, len(nodes)))
        for start in range(0, len(own), step):
            self._over(own[start : start + step], nodes, rows, blocks)

    def _over(self, own: np.ndarray, nodes: np.ndarray, rows: np.ndarray, blocks: list[np.ndarray]) -> None:
        total = self.turned.shape[1]
        reach, done = self.reach(own), 0
        for number, block in enumerate(blocks):
            part = self.turned[own, done : done + block.shape[1]]
            if number == 0:
                near = (part**2).sum(axis=1)[:, None] + (block**2).sum(axis=1)[None, :] - 2 * part @ block.T
                self.compared += near.size
                done = block.shape[1]
                at, row = np.nonzero(near * (total / done) <= (reach * self.margin(done, total))[:, None])
                near = near[at, row]
            else:
                near = near + ((part[at] - block[row]) ** 2).sum(axis=1)
                done += block.shape[1]
                left = near * (total / done) <= reach[at] * self.margin(done, total)
                at, row, near = at[left], row[left], near[left]
        if not len(at):
            return
        self.whole += len(at)
        score = inner(self.queries[own[at]], rows[row])
        good = score >= self.floors[own[at]]
        query, node, score = own[at[good]], nodes[row[good]], score[good]
        touched = np.isin(self.query, own)
        query, node, score = np.concatenate((self.query[touched], query)), np.concatenate((self.node[touched], node)), np.concatenate((self.score[touched], score))
        best = best_of(query, node, score, self.k)
        query, node, score = query[best], node[best], score[best]
        self.query, self.node, self.score = np.concatenate((self.query[~touched], query)), np.concatenate((self.node[~touched], node)), np.concatenate((self.score[~touched], score))
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.empty(0, np.int64)
        counts = np.diff(np.append(-1, last))
        full = last[counts == self.k]
        self.floors[query[full]] = np.maximum(self.floors[query[full]], score[full])

    @staticmethod
    def margin(done: int, total: int) -> float:
        return 1.0 if done == total else (1 + MARGIN / done**0.5) ** 2


def node_table(rows: DataFrame, k: int) -> DataFrame:
    """node, ids, vector: equal vectors once, with their k + 1 smallest ids; node is the smallest."""
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))  # Spark keeps the first k + 1 before it shuffles
    best = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return best.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vector")


def with_lists(nodes: DataFrame, lists: Lists) -> DataFrame:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = doubles(batch.column(1), lists.width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.nearest(x).astype(np.int32) if len(x) else np.empty(0, np.int32))], names=["node", "vector", "list"])

    return nodes.select("node", "vector").mapInArrow(of_batches, "node long, vector array<double>, list int")


@dataclass
class Regions:
    """Of each list, its first region and the number of regions it is cut into."""

    first: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, region_rows: int) -> Regions:
        first, pieces, region, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
        for i, n in enumerate(counts.tolist()):
            if held and held + n > region_rows:
                region, held = region + 1, 0
            first[i], pieces[i] = region, max(1, -(-n // region_rows))
            if pieces[i] > 1:
                region, held = region + int(pieces[i]), 0
            else:
                held += n
        return cls(first, pieces)

    def column(self) -> Column:
        """The region of a row by its list and node."""
        first, pieces = (F.element_at(F.array(*[F.lit(int(v)) for v in x]), F.col("list") + 1) for x in (self.first, self.pieces))
        return (first + F.pmod(F.xxhash64("node"), pieces)).cast("int")


def index_table(placed: DataFrame, lists: Lists, regions: Regions, block: int, chunk_rows: int) -> DataFrame:
    """region, chunk, nodes, own (the list of each row), vectors, blocks (turned columns): rows of a region by list."""
    edges = list(range(0, lists.width + 1, block))

    def build(table: pa.Table) -> pa.Table:
        own, node = table["list"].to_numpy(), table["node"].to_numpy()
        order = np.lexsort((node, own))
        own, node, x = own[order], node[order], doubles(table["vector"], lists.width)[order]
        turned = lists.lifted(x) @ lists.rotation
        out = []
        for number, a in enumerate(range(0, len(own), chunk_rows)):
            part = slice(a, a + chunk_rows)
            blocks = [np.ascontiguousarray(turned[part, e : e + block]).tobytes() for e in edges]
            out.append((table["region"][0].as_py(), number, node[part].tobytes(), own[part].tobytes(), x[part].tobytes(), blocks))
        return pa.Table.from_pylist([dict(zip(INDEX.names, r, strict=True)) for r in out], INDEX)

    dealt = placed.withColumn("region", regions.column())
    return dealt.groupBy("region").applyInArrow(build, "region int, chunk int, nodes binary, own binary, vectors binary, blocks array<binary>")


INDEX = pa.schema([("region", pa.int32()), ("chunk", pa.int32()), ("nodes", pa.binary()), ("own", pa.binary()), ("vectors", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def visits(asked: DataFrame, lists: Lists, regions: Regions, counts: np.ndarray, probes: int, least: int) -> DataFrame:
    """query, region, is_first, probed (the lists of that region, nearest first), vector: one row for each region that
    holds a list which the query probes: its `probes` nearest, and more until they hold `least` rows."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(lists.distances(lists.asked(doubles(batch.column(1), lists.width))), axis=1, kind="stable")
            enough = np.maximum(probes, 1 + (np.cumsum(counts[near], axis=1) < least).sum(axis=1))
            row, region, is_first, probed = [], [], [], []
            for i, own in enumerate(near):
                own = own[: enough[i]]
                found: dict[int, list[int]] = {}
                for one in own.tolist():
                    for r in range(regions.first[one], regions.first[one] + regions.pieces[one]):
                        found.setdefault(int(r), []).append(one)
                row += [i] * len(found)
                region += found
                is_first += [r == regions.first[own[0]] for r in found]
                probed += found.values()
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(region, pa.int32()), pa.array(is_first, pa.bool_()), pa.array(probed, pa.list_(pa.int32())), batch.column(1).take(at)], names=["query", "region", "is_first", "probed", "vector"])

    return asked.select(F.col("node").alias("query"), "vector").mapInArrow(of_batches, "query long, region int, is_first boolean, probed array<int>, vector array<double>")


def searched(table: pa.Table, asked: pa.Table, lists: Lists, k: int, block: int) -> pa.Table:
    """query, node, score: the best k of each query in the chunks of a region."""
    names = ["query", "node", "score"]
    if not table.num_rows or not asked.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
    queries = doubles(asked["vector"], lists.width)
    scan = Scan(queries, lists.asked(queries) @ lists.rotation, asked["floor"].to_numpy(), lists.largest, k)
    probed = asked["probed"].to_pylist()
    wanting: dict[int, list[int]] = {}
    for i, own in enumerate(probed):
        for one in own:
            wanting.setdefault(one, []).append(i)
    heads: dict[int, list[int]] = {}
    for i, own in enumerate(probed):
        heads.setdefault(own[0], []).append(i)
    edges = list(range(0, lists.width + 1, block))
    chunks = []
    for chunk in table.to_pylist():
        node, own = np.frombuffer(chunk["nodes"], np.int64), np.frombuffer(chunk["own"], np.int32)
        x = np.frombuffer(chunk["vectors"]).reshape(len(node), -1)
        blocks = [np.frombuffer(b).reshape(len(node), -1) for b in chunk["blocks"]]
        kinds, starts = np.unique(own, return_index=True)
        for one, a, b in zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            chunks.append((one, node[a:b], x[a:b], [c[a:b] for c in blocks]))
    assert len(edges) == len(chunks[0][3])
    for nearest_first in (True, False):  # the nearest list of each query gives its threshold
        for one, node, x, blocks in chunks:
            first = set(heads.get(one, ()))
            own = [i for i in wanting.get(one, ()) if (i in first) == nearest_first]
            if own:
                scan.over(np.array(own), node, x, blocks)
    ids = asked["query"].to_numpy()
    return pa.table([pa.array(ids[scan.query]), pa.array(scan.node), pa.array(scan.score)], names=names)


def met(index: DataFrame, asked: DataFrame, lists: Lists, k: int, block: int, batch_queries: int) -> DataFrame:
    """Each region with its visitors (query, region, probed, vector, floor), `batch_queries` of them or so at a time."""
    wanted = asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / batch_queries).cast("int").alias("batches"))
    wanted = written(wanted, "meetings")  # a row for each region that is visited
    queries = asked.join(wanted, "region").withColumn("batch", F.pmod(F.xxhash64("query"), F.col("batches").cast("long")))
    queries = queries.select(F.col("region").alias("q_region"), F.col("batch").alias("q_batch"), "query", "probed", "vector", "floor")
    data = index.join(wanted, "region").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - F.lit(1).cast("long")))).drop("batches")

    def meet(table: pa.Table, visitors: pa.Table) -> pa.Table:
        return searched(table, visitors, lists, k, block)

    return data.groupBy("region", "batch").cogroup(queries.groupBy("q_region", "q_batch")).applyInArrow(meet, "query long, node long, score double")


def exact_best(placed: DataFrame, queries: np.ndarray, width: int, k: int) -> DataFrame:
    """query (row number), node, list, score of each query's best k by brute force; queries are few."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = queries @ doubles(batch.column(1), width).T
            near = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(len(queries)), near.shape[1])
            new = [row, batch.column(0).to_numpy()[near.ravel()], batch.column(2).to_numpy()[near.ravel()], scores[row, near.ravel()]]
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            best = best_of(held[0], held[1], held[3], k)
            held = [c[best] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query", "node", "list", "score"])

    found = placed.select("node", "vector", "list").mapInArrow(of_batches, "query long, node long, list int, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def enough_probes(placed: DataFrame, asked: DataFrame, lists: Lists, k: int, recall: float, most_queries: int) -> int:
    """The fewest nearest lists that hold `recall` of the true neighbours of about `most_queries` sampled queries."""
    sample = bounded_sample(asked, "node", most_queries).select("node", "vector").toArrow()
    if not sample.num_rows:
        return 1
    queries, own = doubles(sample["vector"], lists.width), sample["node"].to_numpy()
    near = np.argsort(lists.distances(lists.asked(queries)), axis=1, kind="stable")
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(near.shape[1])[None, :].repeat(len(near), 0), 1)
    true = exact_best(placed, queries, lists.width, k + 1).toArrow()
    query, of, node = true["query"].to_numpy(), true["list"].to_numpy(), true["node"].to_numpy()
    other = node != own[query]
    ranks = np.sort(place[query[other], of[other]])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.96, sample_rows: int = 20_000, sample_queries: int = 128, region_rows: int = 8192, chunk_rows: int = 1024, block: int = 16, batch_queries: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows found with the largest inner product.

    is_query tells the query rows by the column vec_id. Every row is indexed and may be found, but a query's own id is
    never its candidate. Scores are in double precision on the vectors as they are, ties go to the smaller vec_id; with
    fewer candidates all are given. The search is approximate: queries probe so many lists that `recall` of the neighbours
    of `sample_queries` sampled queries lie in them, and tests on partial distances lose a few more. Tables of up to 16 * k
    different vectors are searched whole.

    Vectors null, zero or with null or non-finite components take no part, nor do rows without an id. Repeated rows count
    once; an id with several vectors is searched by each of them and found by its best. Shorter vectors count as padded
    with zeros. An empty table, or one without queries, gives no rows. Other columns are not read.

    sample_rows: the rows on which centres are fitted; there are at most a sixteenth as many lists, and otherwise the
    square root of the number of nodes.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    x = F.transform(embedding, lambda v: v.cast("double"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    rows = vectors.where(F.col(vec_id).isNotNull() & finite(x)).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("vector")).where(F.exists("vector", lambda v: v != 0))
    size = rows.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.max(square).alias("square")).first()
    if size["most"] is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = size["most"]
    if size["least"] != width:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))))
    nodes = written(node_table(rows, k), "nodes")
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asking = written(asking.join(nodes.select("vector", "node"), "vector").select("query_id", "node"), "asking")
    asked = nodes.join(asking.select("node").distinct(), "node", "left_semi")
    count = nodes.count()
    sample = doubles(bounded_sample(nodes, "node", sample_rows).select("vector").toArrow()["vector"], width)
    lists = fitted(sample, size["square"], max(1, min(round(count**0.5), len(sample) // 16)))
    placed = written(with_lists(nodes, lists), "placed")
    counts = np.zeros(len(lists.centres), np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    regions = Regions.of_counts(counts, region_rows)
    probes = len(counts) if count <= 16 * k else enough_probes(placed, asked, lists, k, recall, sample_queries)
    index = written(index_table(placed, lists, regions, block, chunk_rows), "index")
    going = written(visits(asked, lists, regions, counts, probes, k + 1), "visits")
    first = written(met(index, going.where("is_first").withColumn("floor", F.lit(float("-inf"))), lists, k + 1, block, batch_queries), "first-regions")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    floors = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k + 1).select("query", F.col("score").alias("floor"))
    others = going.where("not is_first").join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.union(met(index, others, lists, k + 1, block, batch_queries))
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("query", F.col("node").alias("hit"), "score")
    named = top.join(nodes.select(F.col("node").alias("hit"), "ids"), "hit").select("query", "ids", "score")
    each = asking.join(named, F.col("node") == F.col("query")).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
