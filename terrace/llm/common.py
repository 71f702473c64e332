"""Helpers that the operators share: session set-up, keys and cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a batch that goes to a Python worker, where the session leaves Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BATCH = "67108864b"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and see that a checkpoint folder is set.

    The folder that the cluster names in ``spark.checkpoint.dir`` is used as it
    is; one of our own is made only where none is named and the master is local,
    since executors of a cluster would not see it.  Batches for Python workers are
    held to :data:`BATCH_BYTES`.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, BATCH_BYTES)
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrace-checkpoint-"))
    return spark


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the driver ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{prepare(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(text, UPPER, UPPER.lower())


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as compressed Parquet in the same folder: for wide or long tables of which columns are read apart."""
    path = scratch(df.sparkSession, "stored") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
