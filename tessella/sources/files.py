"""Small files and Parquet parts on any file system: Hadoop's on the driver, Arrow's on executors."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = hadoop(spark, path)
    return bool(system.exists(target))


def length(spark: SparkSession, path: str) -> int | None:
    system, target = hadoop(spark, path)
    return int(system.getFileStatus(target).getLen()) if system.exists(target) else None


def put(spark: SparkSession, path: str, body: bytes) -> None:
    """Under a temporary name first: a reader never sees half a file."""
    system, target = hadoop(spark, path)
    _, temp = hadoop(spark, path + ".tmp")
    out = system.create(temp, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(temp, target):
        raise OSError(f"{path} could not be put in place")


def get(spark: SparkSession, path: str, start: int = 0, size: int | None = None) -> bytes:
    """Bytes of a small file, or of a window of any."""
    system, target = hadoop(spark, path)
    whole = int(system.getFileStatus(target).getLen())
    size = whole - start if size is None else size
    if start < 0 or size < 0 or start + size > whole:
        raise ValueError(f"bytes {start} to {start + size} of {path}, which has {whole}")
    stream = system.open(target)
    try:
        stream.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    system, target = hadoop(spark, path)
    system.delete(target, True)


def names(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Names of the files of a folder, sorted; none where it is missing."""
    system, target = hadoop(spark, path)
    if not system.exists(target):
        return []
    return sorted(n for n in (s.getPath().getName() for s in system.listStatus(target)) if n.endswith(suffix))


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path[:12] else f"file://{path}")
