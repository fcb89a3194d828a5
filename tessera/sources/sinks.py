"""Sinks: guarded CSV export, jobs that count what they write, release projection, snapshots with a pointer."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import spreadsheet_safe, text_hash
from tessera.operators.predicates import RequestError
from tessera.session import settled


def export_csv(df: DataFrame, path: str, max_rows: int, one_file: bool = False, max_bytes: int | None = None, bom: bool = False) -> int:
    """Write all rows as CSV with formula-safe text, or fail before writing if there are more than max_rows, or more than
    max_bytes of values. Returns the number of rows. The rows are computed once and settled; the folder appears only when
    the job has committed, and <path>.manifest then says its rows, bytes and digest (see table_digest). bom: a byte order
    mark before the header, for spreadsheets."""
    df = settled(df, "export")
    safe = df.select(*[spreadsheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 1 for c in safe.columns), F.lit(0))
    facts = safe.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes"), table_digest(safe.columns).alias("digest")).first().asDict()
    if facts["rows"] > max_rows:
        raise RequestError("budget_exceeded", f"{facts['rows']} rows; at most {max_rows} are exported")
    if max_bytes is not None and facts["bytes"] > max_bytes:
        raise RequestError("budget_exceeded", f"{facts['bytes']} bytes; at most {max_bytes} are exported")
    out = safe.withColumnRenamed(safe.columns[0], "\ufeff" + safe.columns[0]) if bom else safe
    (out.coalesce(1) if one_file else out).write.option("header", True).option("escape", '"').csv(path)
    write_manifest(df.sparkSession, path, facts)
    return facts["rows"]


def table_digest(columns: list[str]) -> Column:
    """A digest of all rows as an aggregate, in whatever order they come and as often as they occur: two sums and a count
    of hashes over the columns by name."""
    names = sorted(columns)
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for seed in (1, 2)]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *[s.cast("string") for s in sums]), 256)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{path}.manifest")


def run_job(rows: DataFrame, outcome: str, outcomes: list[str], path: str, max_rows: int | None = None, max_lost: float = 1.0) -> dict:
    """Write rows in one pass, a folder for each outcome, and count them in the same pass; returns the facts that
    <path>.manifest then holds: rows, one number for each outcome, their digest and schema.

    The first outcome is the accepted one. An outcome that isn't named, more than max_rows rows, or a larger share than
    max_lost that isn't accepted is an error; then no manifest is written, and without one the folder is no result.
    """
    seen = Observation("job")
    counters = [F.count(F.when(F.col(outcome) == o, 1)).alias(f"of_{i}") for i, o in enumerate(outcomes)]
    columns = [c for c in rows.columns if c != outcome]
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counters).write.partitionBy(outcome).parquet(path)
    found = seen.get
    facts = {"rows": found["rows"], "outcomes": {o: found[f"of_{i}"] for i, o in enumerate(outcomes)}, "schema": rows.select(*columns).schema.simpleString()}
    if facts["rows"] != sum(facts["outcomes"].values()):
        raise RequestError("unknown_outcome", f"{facts['rows'] - sum(facts['outcomes'].values())} rows have another outcome than {', '.join(outcomes)}")
    if max_rows is not None and facts["rows"] > max_rows:
        raise RequestError("budget_exceeded", f"{facts['rows']} rows; at most {max_rows} are taken in")
    if facts["rows"] - facts["outcomes"][outcomes[0]] > max_lost * facts["rows"]:
        raise RequestError("too_many_lost", f"of {facts['rows']} rows {facts['outcomes'][outcomes[0]]} are {outcomes[0]}")
    facts["digest"] = rows.sparkSession.read.parquet(path).agg(table_digest(rows.columns)).first()[0] if facts["rows"] else None
    write_manifest(rows.sparkSession, path, facts)
    return facts


def released(records: DataFrame, reviews: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The given columns of records whose latest review (by seq) approves them and whose fingerprint it still fits."""
    latest = reviews.groupBy(F.col(key).alias("reviewed_id")).agg(F.max_by(F.struct("decision", "fingerprint"), "seq").alias("review"))
    ok = latest.where("review.decision = 'approved'").select("reviewed_id", F.col("review.fingerprint").alias("reviewed_print"))
    return records.join(ok, (F.col(key) == F.col("reviewed_id")) & (F.col("fingerprint") == F.col("reviewed_print")), "left_semi").select(*columns)


def verified_citations(citations: DataFrame, texts: DataFrame) -> DataFrame:
    """citations (doc_id, start, end, quote, sha256) with sound: the document exists, its hash and the span agree."""
    t = texts.select(F.col("doc_id").alias("cited_id"), F.col("text").alias("cited_text"))
    here = F.col("cited_text").substr(F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")
    sound = F.coalesce(here & (text_hash(F.col("cited_text")) == F.col("sha256")), F.lit(False))
    return citations.join(t, F.col("doc_id") == F.col("cited_id"), "left").withColumn("sound", sound).drop("cited_id", "cited_text")


def publish_snapshot(df: DataFrame, root: str, seq: int) -> str:
    """Write an immutable snapshot folder and a manifest with its schema, row count and digest, then move the pointer of
    root to it. A number that was used, or isn't higher than the pointer's, is an error; nothing is written then."""
    root = root.rstrip("/")
    spark = df.sparkSession
    if (current := current_snapshot(spark, root)) is not None and seq <= current:
        raise RequestError("stale_sequence", f"sequence {seq} isn't higher than {current}")
    path = f"{root}/snapshot-{seq:06d}"
    df.write.mode("error").parquet(path)
    facts = spark.read.schema(df.schema).parquet(path).agg(F.count(F.lit(1)).alias("rows"), table_digest(df.columns).alias("digest")).first().asDict()
    write_manifest(spark, path, {"seq": seq, "schema": df.schema.simpleString(), **facts})
    spark.createDataFrame([(seq,)], "seq long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return path


def current_snapshot(spark: SparkSession, root: str) -> int | None:
    """The number that the pointer of root names: the highest that was ever published; None before the first."""
    try:
        return spark.read.schema("seq long").parquet(f"{root.rstrip('/')}/pointer").agg(F.max("seq")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_snapshot(spark: SparkSession, root: str, seq: int | None = None) -> DataFrame:
    """A published snapshot, the current one by default; one without manifest, or whose rows no longer fit it, is an
    error."""
    seq = current_snapshot(spark, root) if seq is None else seq
    if seq is None:
        raise ValueError("nothing is published there")
    path = f"{root.rstrip('/')}/snapshot-{seq:06d}"
    facts = json.loads(spark.read.text(f"{path}.manifest").first()[0])
    df = spark.read.parquet(path)
    found = df.agg(F.count(F.lit(1)).alias("rows"), table_digest(df.columns).alias("digest")).first()
    if df.schema.simpleString() != facts["schema"] or (found["rows"], found["digest"]) != (facts["rows"], facts["digest"]):
        raise ValueError("the snapshot differs from its manifest")
    return df
