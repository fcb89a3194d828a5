"""GeoJSON feature collections of any size, read by several tasks each.

A block of bytes can't know whether it begins inside a string, nor how deep in brackets. So all blocks first say, for
either beginning, whether they end inside a string and by how much the depth changes; the driver links these facts, one
row for each block, and then each block finds the features that begin in it: objects at depth two, in an array of the
root. The last feature of a block is read to its end in the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.predicates import RequestError

QUOTE, BACKSLASH, OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST = (ord(c) for c in '"\\{}[]')
#: Depth of brackets in which features stand: the root and its list.
FEATURE_DEPTH = 2


def opened(path: str) -> pa.NativeFile:
    """A file by the URI that Spark gives it; stores that Arrow doesn't know are an error."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def clean_edge(file: pa.NativeFile, at: int, size: int) -> int:
    """The first place from `at` on that has no backslash before it, so that no escape is cut."""
    while 0 < at < size:
        before = np.frombuffer(file.read_at(1024, at - 1), np.uint8)
        plain = np.flatnonzero(before != BACKSLASH)
        if len(plain):
            return min(at + int(plain[0]), size)
        at += len(before)
    return min(at, size)


@dataclass
class Scan:
    """Of each byte, the number of unescaped quotes up to it, and the change of depth it would be outside of strings."""

    data: np.ndarray
    quotes: np.ndarray
    change: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Scan:
        a = np.frombuffer(data, np.uint8)
        quote, slash = a == QUOTE, a == BACKSLASH
        if slash.any():
            place = np.arange(len(a))
            last = np.maximum.accumulate(np.where(slash, -1, place))
            at = np.flatnonzero(quote)
            run = np.where(at > 0, at - 1 - last[np.maximum(at - 1, 0)], 0)
            quote[at[run % 2 == 1]] = False
        change = np.isin(a, (OPEN_OBJECT, OPEN_LIST)).astype(np.int8) - np.isin(a, (CLOSE_OBJECT, CLOSE_LIST)).astype(np.int8)
        return cls(a, np.cumsum(quote), change)

    def outside(self, in_string: bool) -> np.ndarray:
        return (self.quotes + in_string) % 2 == 0

    def effect(self) -> tuple[bool, int, int]:
        """Whether it turns a string on or off, and the change of depth from outside and from inside a string."""
        depths = [int(self.change[self.outside(s)].sum(dtype=np.int64)) for s in (False, True)]
        return bool(len(self.quotes) and self.quotes[-1] % 2), *depths

    def features(self, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where features begin and where they end."""
        outside = self.outside(in_string)
        after = depth + np.cumsum(np.where(outside, self.change, 0), dtype=np.int64)
        starts = np.flatnonzero(outside & (self.data == OPEN_OBJECT) & (after == FEATURE_DEPTH + 1))
        return starts, np.flatnonzero(outside & (self.data == CLOSE_OBJECT) & (after == FEATURE_DEPTH)) + 1


def feature_texts(spark: SparkSession, path: str, block_bytes: int = 32 << 20, max_feature_bytes: int = 64 << 20) -> DataFrame:
    """path, start (its byte), feature (its text): the objects in lists of the root of each file. A longer feature than
    max_feature_bytes is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # a row for each file
    blocks = [(f["path"], f["length"], a, min(a + block_bytes, f["length"])) for f in files for a in range(0, f["length"], block_bytes)]
    schema = "path string, size long, start long, stop long"
    plan = spark.createDataFrame(blocks, schema).repartition(max(1, len(blocks)))

    def read(file: pa.NativeFile, size: int, start: int, stop: int) -> tuple[int, bytes]:
        start, stop = clean_edge(file, start, size), clean_edge(file, stop, size)
        return start, file.read_at(max(0, stop - start), start)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    _, data = read(file, r["size"], r["start"], r["stop"])
                rows.append((r["path"], r["start"], *Scan.of(data).effect()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["path", "start", "turns", "plain", "quoted"])

    known: dict[tuple[str, int], tuple[bool, int]] = {}
    own, in_string, depth = None, False, 0
    for r in plan.mapInArrow(effects, "path string, start long, turns boolean, plain long, quoted long").orderBy("path", "start").collect() if blocks else []:
        if r["path"] != own:
            own, in_string, depth = r["path"], False, 0
        known[r["path"], r["start"]] = (in_string, depth)
        in_string, depth = in_string != r["turns"], depth + (r["quoted"] if in_string else r["plain"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    first, data = read(file, r["size"], r["start"], r["stop"])
                    length, more = len(data), 1 << 16
                    state = known[r["path"], r["start"]]
                    starts, ends = Scan.of(data).features(*state)
                    while len(starts) and not (ends > starts[-1]).any() and first + len(data) < r["size"]:
                        if len(data) - starts[-1] > max_feature_bytes:
                            raise RequestError("budget_exceeded", f"a feature of more than {max_feature_bytes} bytes")
                        data += file.read_at(more, first + len(data))
                        more *= 2
                        starts, ends = Scan.of(data).features(*state)
                        starts = starts[starts < length]
                starts = starts[starts < length]
                stops = ends[np.minimum(np.searchsorted(ends, starts, side="right"), max(len(ends) - 1, 0))] if len(ends) else starts
                texts = [data[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(texts), pa.string()), pa.array((first + starts)[stops > starts], pa.int64()), pa.array(texts, pa.string())], names=["path", "start", "feature"])

    return plan.mapInArrow(features, "path string, start long, feature string")


def geojson_features(spark: SparkSession, path: str, properties: list[str], block_bytes: int = 32 << 20) -> DataFrame:
    """The properties, kind and rings (lists of [lon, lat]) of the polygons of feature collections; a multi-polygon has a
    row for each of its polygons. Objects without a geometry, or of another type, are none. Files of several blocks are read
    by several tasks."""
    own = ", ".join(f"`{p}`: STRING" for p in properties)
    shape = f"type STRING, properties STRUCT<{own}>, geometry STRUCT<type: STRING, coordinates: STRING>" if properties else "type STRING, geometry STRUCT<type: STRING, coordinates: STRING>"
    feature = feature_texts(spark, path, block_bytes).select(F.from_json("feature", shape).alias("f")).where("coalesce(f.type, 'Feature') = 'Feature' and f.geometry is not null")
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one, many = F.from_json(coordinates, "ARRAY<ARRAY<ARRAY<DOUBLE>>>"), F.from_json(coordinates, "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return feature.select(*[F.col(f"f.properties.{p}").alias(p) for p in properties], kind.alias("kind"), F.explode(polygons).alias("rings"))
