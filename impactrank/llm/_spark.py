"""Session helpers of the corpus operators: shipping code, shared tables, batches."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ._text import BATCH_ROWS, CHUNK_BYTES

#: Bytes of a row group of intermediate tables, which a task holds while it writes.
ROW_GROUP = 16 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on executors and bound Arrow batches in rows and bytes.

    The package goes through Spark's own file server, once per application.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="code")
        target = os.path.join(folder, "impactrank_code.zip")
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted((root / "impactrank").rglob("*.py")):
                z.write(p, p.relative_to(root))
        Path(target).write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors and the driver see.

    Where the setting is missing (tests in local mode) a temporary folder serves;
    with any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in a shared folder and read it back."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, folder: str, name: str = "") -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
