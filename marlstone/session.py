"""Session settings and table access shared by every part of the engine."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the engine expects; a cluster sets its own master."""
    spark = (
        SparkSession.builder.master(master)
        .appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder there that all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="marlstone-"))
    return _scratch[0]


#: Sizes are looked at after each row, and not after a hundred: rows of megabytes would make pages of hundreds.
_WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "compression": "none"}


def durable(df: DataFrame, wide: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files outlive lost executors, unlike a local checkpoint, and are read by column. ``wide``
    is for rows of up to megabytes that do not compress, such as packed hashes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/marlstone-{uuid.uuid4().hex}"
    df.write.options(**(_WIDE if wide else {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.durable_path = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder by any path that Spark opens."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a ``durable`` table after its last reader."""
    delete(df.sparkSession, df.durable_path)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of an Arrow batch, which both the executor and its Python workers hold outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bound_reads(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows that a Parquet reader decodes at once: 4,096 long texts make arrays that the executor's heap grows for."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
