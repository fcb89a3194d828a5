"""Media columns (operator 5): ISO media containers in a binary column.

`to_media` stores bytes losslessly as 8-bit samples of an ISO base media file. `describe_media` walks the nested boxes
of any such file, decodes the sample tables and gives codec, duration and the byte ranges of the keyframes without
decoding a payload; `payload` follows the same tables to the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import kept, kept_schema

SAMPLE_BYTES = 192
TIMESCALE = 8000
KEYFRAME_EVERY = 16
SAMPLES_PER_CHUNK = 64
#: Boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """data and blanks up to a positive multiple of the sample size."""
    return data + b" " * (-len(data) % SAMPLE_BYTES if data else SAMPLE_BYTES)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _numbers(values: list[int], kind: str = "I") -> bytes:
    return struct.pack(f">I{len(values)}{kind}", len(values), *values)


def build_media(payload: bytes) -> bytes:
    """An ISO media file with one track of 8-bit PCM; the payload must be whole samples.

    A keyframe stands at every KEYFRAME_EVERY-th sample, SAMPLES_PER_CHUNK samples make a chunk.
    """
    n, rest = divmod(len(payload), SAMPLE_BYTES)
    if rest or not n:
        raise ValueError("the payload must be a positive number of whole samples")
    ticks = n * SAMPLE_BYTES
    chunks = -(-n // SAMPLES_PER_CHUNK)
    last = n - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if last == SAMPLES_PER_CHUNK else [(1, last, 1)] if chunks == 1 else [(1, SAMPLES_PER_CHUNK, 1), (chunks, last, 1)]
    entry = _box(b"ipcm", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16), _full(b"pcmC", b"\0\x08"))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")

    def movie(first: int) -> bytes:
        offsets = [first + i * SAMPLES_PER_CHUNK * SAMPLE_BYTES for i in range(chunks)]
        places = _full(b"stco", _numbers(offsets)) if offsets[-1] < 1 << 32 else _full(b"co64", _numbers(offsets, "Q"))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            _full(b"stss", _numbers(list(range(1, n + 1, KEYFRAME_EVERY)))),
            _full(b"stsc", struct.pack(f">I{3 * len(runs)}I", len(runs), *[x for run in runs for x in run])),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            places,
        )
        information = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        track = _box(
            b"trak",
            _full(b"tkhd", struct.pack(">5I8xhhhH", 0, 0, 1, 0, ticks, 0, 0, 256, 0), MATRIX, bytes(8), flags=3),
            _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), information),
        )
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 256), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    wide = len(payload) + 8 >= 1 << 32
    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    before = len(head) + len(movie(0)) + len(data)
    return head + movie(before) + data + payload


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the content of each box between start and end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if start + size > end or body > start + size:
            raise ValueError(f"box {kind!r} at {start} exceeds its parent")
        yield kind, body, start + size
        start += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: list[int]
    sizes: list[int]
    keyframes: list[int]

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """First byte and length of each keyframe."""
        return [(self.offsets[k - 1], self.sizes[k - 1]) for k in self.keyframes]


def _table(data: memoryview, at: int, width: int, kind: str = "I") -> list[tuple[int, ...]]:
    n = struct.unpack_from(">I", data, at + 4)[0]
    flat = struct.unpack_from(f">{n * width}{kind}", data, at + 8)
    return list(zip(*[iter(flat)] * width, strict=True))


def _compact_sizes(data: memoryview, at: int) -> list[int]:
    """The sizes of a compact table: fields of 4, 8 or 16 bits."""
    width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if width == 4:
        return [data[at + 12 + i // 2] >> (0 if i % 2 else 4) & 15 for i in range(n)]
    if width not in (8, 16):
        raise ValueError(f"sample sizes of {width} bits")
    return list(struct.unpack_from(f">{n}{'B' if width == 8 else 'H'}", data, at + 12))


def _track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> Track:
    at = {k: v[0] for k, v in found.items()}
    for kinds in ((b"mdhd",), (b"stsd",), (b"stsc",), (b"stsz", b"stz2"), (b"stco", b"co64")):
        if not any(k in at for k in kinds):
            raise ValueError(f"a track has no {' or '.join(k.decode() for k in kinds)} box")
    long = data[at[b"mdhd"]] == 1
    timescale, duration = struct.unpack_from(">IQ" if long else ">II", data, at[b"mdhd"] + (20 if long else 12))
    codec = bytes(data[at[b"stsd"] + 12 : at[b"stsd"] + 16]).decode("latin-1")
    if b"stsz" in at:
        fixed, n = struct.unpack_from(">II", data, at[b"stsz"] + 4)
        sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, at[b"stsz"] + 12))
    else:
        sizes = _compact_sizes(data, at[b"stz2"])
    chunks = [x for (x,) in (_table(data, at[b"stco"], 1) if b"stco" in at else _table(data, at[b"co64"], 1, "Q"))]
    runs = _table(data, at[b"stsc"], 3)
    offsets: list[int] = []
    for i, (first, per_chunk, _) in enumerate(runs):
        end = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for chunk in chunks[first - 1 : end - 1]:
            place = chunk
            for size in sizes[len(offsets) : len(offsets) + per_chunk]:
                offsets.append(place)
                place += size
    if len(offsets) != len(sizes):
        raise ValueError("sample tables disagree")
    keyframes = [x for (x,) in _table(data, at[b"stss"], 1)] if b"stss" in at else list(range(1, len(sizes) + 1))
    return Track(codec, timescale, duration, offsets, sizes, keyframes)


def read_tracks(media: bytes) -> list[Track]:
    """All tracks, from the nested boxes alone. A fragmented file, a track without a table that it needs, tables that
    disagree and boxes that exceed their parents are errors (ValueError)."""
    data, tracks = memoryview(media), []

    def walk(start: int, end: int, found: dict[bytes, tuple[int, int]]) -> None:
        for kind, body, stop in boxes(data, start, end):
            if kind == b"moof":
                raise ValueError("the samples of fragmented files are not in sample tables")
            if kind == b"trak":
                own: dict[bytes, tuple[int, int]] = {}
                walk(body, stop, own)
                tracks.append(_track(data, own))
            elif kind in CONTAINERS:
                walk(body, stop, found)
            else:
                found[kind] = (body, stop)

    walk(0, len(data), {})
    return tracks


def payload(media: bytes, track: Track) -> bytes:
    """The samples' bytes; samples that follow each other are read at once."""
    out, begin, end = [], 0, 0
    for offset, size in zip(track.offsets, track.sizes, strict=True):
        if offset != end:
            out.append(media[begin:end])
            begin = offset
        end = offset + size
    out.append(media[begin:end])
    return b"".join(out)


def to_media(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, n_bytes and media: each whole text (null: empty) as a media file.

    One row for each row of docs, repeated ones too; an empty table gives no rows. A kept column with the name of a
    result is called kept_<name>.
    """
    names = [*docs.select(*kept(keep, ["n_bytes", "media"])).columns, "n_bytes", "media"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = batch.slice(i, 1)
                data = data or b""
                columns = [*own.columns[:-1], pa.array([len(data)], pa.int64()), pa.array([build_media(padded(data))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, F.col(text).cast("binary").alias("stored_text")).mapInArrow(of_batches, kept_schema(docs, keep, "n_bytes long, media binary"))


def describe_media(table: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns `keep`, codec, duration (seconds), keyframes (structs of offset and bytes), payload_bytes,
    payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256.

    Of a file with several tracks the first counts; one without a track gives null for what a track tells. A null medium
    gives nulls; a broken one is an error. One row for each row of table; an empty table gives no rows. A kept column
    with the name of a result is called kept_<name>.
    """
    added = "codec string, duration double, keyframes array<struct<offset:long,bytes:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    results = ["codec", "duration", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    names = [*table.select(*kept(keep, results)).columns, *results]

    def described(data: bytes) -> list:
        tracks = read_tracks(data)
        if not tracks:
            return [None] * 6 + [len(data), hashlib.sha256(data).hexdigest()]
        track = tracks[0]
        stored = payload(data, track)
        ranges = [{"offset": a, "bytes": b} for a, b in track.keyframe_ranges()]
        return [track.codec, track.duration / track.timescale, ranges, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest()]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(x) if x is not None else [None] * len(kinds) for x in batch.column(batch.num_columns - 1).to_pylist()]
            added_columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added_columns], names=names)

    return table.select(*keep, F.col(media).alias("read_media")).mapInArrow(of_batches, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*kept(keep, results)).schema], added]))


def feature_text() -> Column:
    """One line: codec, duration, keyframe count and bytes, first and last keyframe, a digest of all ranges."""
    ranges = F.transform("keyframes", lambda x: F.concat_ws("+", x["offset"], x["bytes"]))
    total = F.aggregate("keyframes", F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    return F.format_string(
        "codec=%s;duration=%.3f;keyframes=%d;keyframe_bytes=%d;first=%s;last=%s;ranges_md5=%s",
        "codec", "duration", F.size("keyframes"), total, F.element_at(ranges, 1), F.element_at(ranges, -1), F.md5(F.array_join(ranges, ",")),
    )
