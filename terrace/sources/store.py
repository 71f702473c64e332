"""A partitioned table on files, with a versioned catalogue.

Data files are written once and never changed.  A version of the catalogue lists
the tree and, for each leaf, the folders that hold its rows; publishing a version
is one atomic step, so readers see a move from DEFAULT to a partition whole or not
at all.  Versions are Parquet under ``_catalog``; the current one is the highest
whose marker exists.  All paths go through Hadoop's file system, so the table may
lie in any store that Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from terrace.errors import LockHeld, PlanStale
from terrace.sources.catalogue import NODES

ENTRY = NODES + ", state string, detached_at bigint, folders array<string>"
ATTACHED, DETACHED = "attached", "detached"


class Files:
    """What is needed of Hadoop's file system below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def create(self, name: str, text: str = "") -> bool:
        """A file with this text; false if it exists already: only one of several writers gets True."""
        at = self._path(self.path(name))
        self._fs.mkdirs(at.getParent())
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        """Of a small file; empty if there is none."""
        if not self.exists(name):
            return ""
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(stream.readNBytes(1 << 24)).decode()
        finally:
            stream.close()

    def age(self, name: str) -> float:
        """Seconds since the file was last written."""
        return time.time() - self._fs.getFileStatus(self._path(self.path(name))).getModificationTime() / 1000

    def touch(self, name: str) -> None:
        self._fs.setTimes(self._path(self.path(name)), int(time.time() * 1000), -1)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def names(self, folder: str) -> list[str]:
        at = self._path(self.path(folder))
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []


@dataclass(frozen=True)
class Store:
    """``schema`` is of the rows; ``table`` names the root; ``options`` are the Parquet writer's."""

    spark: SparkSession
    root: str
    table: str
    schema: StructType
    options: tuple[tuple[str, str], ...] = ()
    grace: float = 3600.0  # seconds for which readers of an older version keep its files
    patience: float = 3600.0  # seconds after which a lock that nobody renews counts as left by a dead writer

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    # --- versions -----------------------------------------------------------------------------------------------------

    @property
    def version(self) -> int:
        """0 for a table that does not exist yet."""
        done = [int(n[2:-5]) for n in self.files.names("_catalog") if n.startswith("v=") and n.endswith(".done")]
        return max(done, default=0)

    def entries(self, version: int | None = None) -> DataFrame:
        at = self.version if version is None else version
        if at == 0:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(_parse_datatype_string(ENTRY)).parquet(self.files.path(f"_catalog/{self.files.text(f'_catalog/v={at}.done')}"))

    def publish(self, entries: DataFrame, expected: int) -> int:
        """Make ``entries`` the version after ``expected``; PlanStale if another writer was first.

        Every attempt writes a folder of its own; the marker, which only one writer
        can create, names the one that counts.
        """
        if self.version != expected:
            raise PlanStale(f"{self.table} is at version {self.version}, not {expected}")
        following, folder = expected + 1, f"v={expected + 1}-{uuid.uuid4().hex}"
        entries.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(ENTRY).fields]).coalesce(1).write.parquet(self.files.path(f"_catalog/{folder}"))
        if not self.files.create(f"_catalog/v={following}.done", folder):
            self.files.delete(f"_catalog/{folder}")
            raise PlanStale(f"another writer made version {following} of {self.table}")
        return following

    # --- the lock -----------------------------------------------------------------------------------------------------

    def lock(self) -> Lock:
        return Lock(self.files, self.table, self.patience)

    # --- reading ------------------------------------------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        return self.entries().where(F.col("state") == ATTACHED).select(*[f.name for f in _parse_datatype_string(NODES).fields])

    def orphans(self) -> DataFrame:
        return self.entries().where(F.col("state") == DETACHED).select("name", "parent_name", "relkind", "detached_at")

    def read(self, *names: str) -> DataFrame:
        """The rows of these partitions and all below them; of the whole attached tree without names."""
        rows = self.entries().where("folders is not null").select("name", "folders", "state").collect()  # a row a leaf
        if names:
            rows = [r for r in rows if any(r.name == n or r.name.startswith(n + "__") for n in names)]
        else:
            rows = [r for r in rows if r.state == ATTACHED]
        paths = [self.files.path(f) for r in rows for f in r.folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- writing ------------------------------------------------------------------------------------------------------

    def stage(self, df: DataFrame, by: str) -> dict[str, str]:
        """Write rows into a new folder for each value of ``by``; the folder of each value."""
        batch = f"data/{uuid.uuid4().hex}"
        df.select(*[f.name for f in self.schema.fields], F.col(by).alias("__leaf")).hint("rebalance", F.col("__leaf")).write.options(**dict(self.options)).partitionBy("__leaf").parquet(self.files.path(batch))
        return {n.split("=", 1)[1]: f"{batch}/{n}" for n in self.files.names(batch) if n.startswith("__leaf=")}

    def drop_folders(self, folders: list[str]) -> None:
        """Folders that the current version no longer names: deleted once ``grace`` is over, by whoever comes here then."""
        if folders:
            self.files.create(f"_garbage/{uuid.uuid4().hex}", json.dumps(folders))
        for note in self.files.names("_garbage"):
            if not note.startswith(".") and self.files.age(f"_garbage/{note}") >= self.grace:
                for f in json.loads(self.files.text(f"_garbage/{note}") or "[]"):
                    self.files.delete(f)
                self.files.delete(f"_garbage/{note}")


class Lock:
    """One writer a table: a file that only one can create.

    It names its holder.  A lock that has not been renewed for ``patience`` seconds
    is taken over, so a writer that died holds a table up for so long and no longer.
    """

    def __init__(self, files: Files, table: str, patience: float = 3600.0) -> None:
        self.files, self.table, self.patience, self.holder = files, table, patience, uuid.uuid4().hex

    @property
    def held(self) -> bool:
        return self.files.exists("_lock")

    def renew(self) -> None:
        if self.files.text("_lock") != self.holder:
            raise LockHeld(f"{self.table} is locked by another writer")
        self.files.touch("_lock")

    def __enter__(self) -> Lock:
        if self.held and self.files.age("_lock") >= self.patience:
            self.files.delete("_lock")
        if not self.files.create("_lock", self.holder):
            raise LockHeld(f"{self.table} is locked")
        return self

    def __exit__(self, *_: object) -> None:
        if self.files.text("_lock") == self.holder:
            self.files.delete("_lock")


def merged(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
