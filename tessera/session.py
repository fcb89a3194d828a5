"""What a run needs of its Spark session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir, or the one given to setCheckpointDir.

    Where both are unset, a local master, as in tests, gets a folder of this machine; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of iterative operators; survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Rows of an Arrow batch, unless the session sets its own number: texts are kilobytes long, and a task holds a batch
#: both in Spark and in Python.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that Python functions find it wherever the driver runs; once a context. Arrow
    batches get a size that suits texts."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own number
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(str(archive))
    context._tessera_shipped = True
