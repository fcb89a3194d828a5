"""Structured Streaming: replay-safe ingest of files, first version of each key, tumbling counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.session import shared_folder


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest_once(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Append each key's first version to Parquet, in one folder for each batch. A batch that runs again overwrites its
    own folder, and keys of earlier batches are left out, so a replay changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if number:  # a first batch, and its replay, has none before it
            known = read_log(spark, target, batch.schema, number).select(key).distinct()
            new = new.join(known, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, target: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
    """The rows of the log's batches, or of those before one; a batch without rows is a folder without files."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())]) if isinstance(schema, T.StructType) else f"{schema}, batch long"
    log = spark.read.schema(numbered).option("basePath", target).option("ignoreMissingFiles", True).parquet(f"{target}/batch=*")
    return log if before is None else log.where(F.col("batch") < before)


def standing_events(log: DataFrame, document: str, seq: str, operation: str, supersedes: str) -> DataFrame:
    """The upserts of an append-only event log that stand: no later event of their document withdraws it, and no event
    that stands names them as superseded. Corrections and withdrawals only append, so each batch recomputes the state."""
    gone = log.where(F.col(operation) == "withdraw").groupBy(F.col(document).alias("gone_doc")).agg(F.max(seq).alias("gone_seq"))
    alive = log.where(F.col(operation) == "upsert").join(gone, F.col(document) == F.col("gone_doc"), "left").where(F.col("gone_seq").isNull() | (F.col(seq) > F.col("gone_seq"))).drop("gone_doc", "gone_seq")
    named = alive.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("named_seq")).distinct()
    return alive.join(named, F.col(seq) == F.col("named_seq"), "left_anti")


def new_place(folder: str) -> str:
    """A new folder in the shared one for a stream's log and checkpoint."""
    return f"{folder.rstrip('/')}/tessera/stream-{uuid.uuid4().hex}"


def tumbling_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, keys, n; rows later than `late` behind the newest are dropped by the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def first_versions(stream: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def session_counts(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "2 days") -> DataFrame:
    """start, end, keys, n of each key's sessions: a session ends when nothing came for `gap`; rows later than `late`
    behind the newest are dropped by the watermark. An extension: there is no such operator among the batch ones."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def sliding_counts(stream: DataFrame, time: str, keys: list[str], size: str, slide: str, late: str = "2 days") -> DataFrame:
    """start, keys, n of windows of `size` that begin every `slide`. An extension, as session_counts."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def silences(stream: DataFrame, key: str, time: str, hours: int, late: str = "1 hour") -> DataFrame:
    """key, last_seen, n: a row each time that a key has been silent for `hours`, with the number of rows before. State
    of each key: its newest time and a count; an event-time timer ends it. An extension, as session_counts."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def watch(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [own[0]], "last_seen": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for frame in frames:
            last, n = max(last, int(frame["micros"].max())), n + len(frame)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    timed = stream.select(F.col(key), F.col(time).cast("timestamp").alias(time)).withColumn("micros", F.unix_micros(time)).withWatermark(time, late)
    return timed.groupBy(key).applyInPandasWithState(watch, f"`{key}` {kind}, last_seen timestamp, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def appended(result: DataFrame, place: str) -> DataFrame:
    """Run an append-mode stream over all that is there now and give what it has written. A replay from the checkpoint in
    `place` adds nothing."""
    run = result.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{place}/out")


def final_state(aggregated: DataFrame) -> DataFrame:
    """Run a stream's aggregate over all that is there now and give its last complete state."""
    spark = aggregated.sparkSession
    place = new_place(shared_folder(spark))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/state-{number:06d}")
        last.append(number)

    last: list[int] = []
    run = aggregated.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], aggregated.schema)
    return spark.read.schema(aggregated.schema).parquet(f"{place}/state-{last[-1]:06d}")
