"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that the machine's own folders will do."""
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and the session runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Scratch paths of a session; what is still there when the driver ends is removed then."""

    def __init__(self) -> None:
        self.held: dict[str, SparkSession] = {}
        atexit.register(self.free)

    def new(self, spark: SparkSession, label: str) -> str:
        path = f"{shared_dir(spark)}/tessella-{label}-{uuid.uuid4().hex}"
        self.held[path] = spark
        return path

    def free(self, but: set[str] | frozenset = frozenset(), since: set[str] | frozenset = frozenset()) -> None:
        """Removes all paths but these and those that were there `since` before."""
        for path in [p for p in self.held if p not in but and p not in since]:
            try:
                remove(self.held.pop(path), path)
            except Exception:  # noqa: BLE001  the session may have ended before
                pass


SCRATCH = Scratch()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return SCRATCH.new(spark, label)


def held() -> set[str]:
    """The scratch paths there are."""
    return set(SCRATCH.held)


def cut(df: DataFrame, label: str, since: set[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here.

    With `since` (from `held`), scratch tables made after that are removed once this one is written:
    for a caller that knows that nothing else reads them.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    if since is not None:
        SCRATCH.free(but={path}, since=since)
    return spark.read.schema(df.schema).parquet(path)
