"""Sources with explicit schemas: JSON lines, CSV with known headers, mail files, generated rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.predicates import RequestError, bounded

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: T.StructType, max_rows: int | None = None, max_line_bytes: int | None = None) -> DataFrame:
    """Rows of a strict schema: a broken line is an error, and so are a line of over max_line_bytes and more than
    max_rows rows."""
    if max_line_bytes is not None and not spark.read.text(path).where(F.octet_length("value") > max_line_bytes).isEmpty():
        raise RequestError("budget_exceeded", f"a line of more than {max_line_bytes} bytes")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return bounded(df, max_rows) if max_rows is not None else df


def json_lines_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the broken lines as text."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    sound = F.col(f"r.{CORRUPT}").isNull()
    return parsed.where(sound).select("r.*").drop(CORRUPT), parsed.where(~sound).select("value")


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def csv_table(spark: SparkSession, path: str, headers: Mapping[str, list[str]], required: list[str], multi_line: bool = False) -> DataFrame:
    """Columns of the given names, found by any of their header spellings; all strings. A missing required one is an
    error, other columns are left out. multi_line: values may hold line ends; such files can't be split."""
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    known = {header_key(c): c for c in df.columns}
    found = {name: next((known[k] for k in map(header_key, [name, *spellings]) if k in known), None) for name, spellings in headers.items()}
    if missing := [n for n in required if not found[n]]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in found.items()])


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """path, message_id, sender, recipients, sent, subject, body of .eml files; addresses are lower-cased."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from email import message_from_bytes, policy
        from email.utils import getaddresses

        names = ["path", "message_id", "sender", "recipients", "sent", "subject", "body"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mail = message_from_bytes(data, policy=policy.default)
                body = mail.get_body(("plain", "html"))
                sender = [a.lower() for _, a in getaddresses(mail.get_all("from", [])) if a]
                to = [a.lower() for _, a in getaddresses([*mail.get_all("to", []), *mail.get_all("cc", [])]) if a]
                rows.append((name, mail["message-id"], sender[0] if sender else None, to, mail["date"], mail["subject"], body.get_content() if body else None))
            yield pa.RecordBatch.from_arrays([pa.array([None if r[i] is None else r[i] if i == 3 else str(r[i]) for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return raw.mapInArrow(of_batches, "path string, message_id string, sender string, recipients array<string>, sent string, subject string, body string")


def csv_kind(spark: SparkSession, path: str, kinds: Mapping[str, tuple[Mapping[str, list[str]], list[str]]]) -> str:
    """Which of the kinds (name -> headers, required; see csv_table) a file is, by its header line alone: the one all of
    whose required columns are there, of several the one with most known columns. None or two alike are an error."""
    known = {header_key(c) for c in spark.read.option("header", True).option("escape", '"').csv(path).columns}
    fits = {}
    for name, (headers, required) in kinds.items():
        there = {n for n, spellings in headers.items() if {header_key(x) for x in (n, *spellings)} & known}
        if set(required) <= there:
            fits[name] = len(there)
    best = [n for n, k in fits.items() if k == max(fits.values())]
    if len(best) != 1:
        raise ValueError(f"the columns fit {' and '.join(best) or 'no kind'}: {', '.join(sorted(known))}")
    return best[0]


def csv_with_rejects(spark: SparkSession, path: str, headers: Mapping[str, list[str]], required: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sound rows of a CSV file (see csv_table), and the broken ones as line and reason: wrong_width (more or fewer values
    than the header names) or missing_<column> (a required value is blank). columns: the header line's names, in order."""
    wide = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(wide).option("header", True).option("enforceSchema", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    known = {header_key(c): c for c in columns}
    found = {name: next((known[k] for k in map(header_key, [name, *spellings]) if k in known), None) for name, spellings in headers.items()}
    if missing := [n for n in required if not found[n]]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    blank = [F.when(F.col(f"`{found[n]}`").isNull() | (F.trim(f"`{found[n]}`") == ""), F.lit(f"missing_{n}")) for n in required]
    reason = F.coalesce(F.when(F.col(CORRUPT).isNotNull(), "wrong_width"), *blank, F.lit(None).cast("string"))
    marked = raw.withColumn("reason", reason)
    line = F.coalesce(CORRUPT, F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]))
    sound = marked.where("reason is null").select(*[F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in found.items()])
    return sound, marked.where("reason is not null").select(line.alias("line"), "reason")


def generated_requests(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Requests for load tests: areas 35/25/20/15/5, problems 60/25/15, four fifths closed, exponential hours of mean
    30, three in a hundred without a place."""
    def pick(column: str, *steps: tuple[float, str]) -> F.Column:
        out = None
        for share, name in steps:
            out = F.when(F.col(column) < share, name) if out is None else out.when(F.col(column) < share, name)
        return out

    df = spark.range(rows).withColumns({f"u{i}": F.rand(seed + i) for i in range(6)})
    created = F.timestamp_seconds(F.lit(1735689600) + F.floor(F.col("u0") * 31536000))
    closed = F.col("u3") < 0.8
    hours = -30 * F.log(1 - F.col("u4"))
    return df.select(
        F.format_string("GEN-%012d", "id").alias("request_id"), created.alias("created"),
        pick("u1", (0.35, "north"), (0.60, "east"), (0.80, "south"), (0.95, "west"), (1.01, "isle")).alias("area"),
        pick("u2", (0.60, "noise"), (0.85, "heat"), (1.01, "pests")).alias("problem"),
        F.when(closed, "Closed").otherwise("Open").alias("status"), F.when(closed, hours).alias("closure_hours"),
        F.when(F.col("u5") >= 0.03, F.struct((40.5 + F.col("u0") * 0.4).alias("lat"), (-74.2 + F.col("u1") * 0.5).alias("lon"))).alias("location"),
    )
