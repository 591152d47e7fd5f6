"""Where whole collections may be kept beside the file systems that Spark reads: any object with four methods.

Spark reads and writes folders itself; a store of another kind takes a finished collection file by
file, manifest last, and gives it back into a folder. Each file goes through the driver whole.
"""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import SparkSession

from tessella.errors import UnfinishedCollectionError
from tessella.sources import files
from tessella.sources.manifest import NAME, Manifest
from tessella.sources.store import Collection


class Store(Protocol):
    def put(self, key: str, body: bytes) -> None: ...

    def get(self, key: str, start: int = 0, size: int | None = None) -> bytes: ...

    def names(self, prefix: str = "") -> list[str]: ...

    def delete(self, key: str) -> None: ...


class MemoryStore:
    """Bytes by key."""

    def __init__(self) -> None:
        self.held: dict[str, bytes] = {}

    def put(self, key: str, body: bytes) -> None:
        self.held[key] = bytes(body)

    def get(self, key: str, start: int = 0, size: int | None = None) -> bytes:
        body = self.held[key]
        return body[start:] if size is None else body[start : start + size]

    def names(self, prefix: str = "") -> list[str]:
        return sorted(k for k in self.held if k.startswith(prefix))

    def delete(self, key: str) -> None:
        self.held.pop(key, None)


class DirectoryStore:
    """Files under a folder of this machine; each is put under another name first."""

    def __init__(self, root: str) -> None:
        self.root = root

    def path(self, key: str) -> str:
        out = os.path.normpath(os.path.join(self.root, key))
        if not out.startswith(os.path.normpath(self.root) + os.sep):
            raise ValueError(f"{key!r} is not inside the store")
        return out

    def put(self, key: str, body: bytes) -> None:
        path = self.path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".tmp", "wb") as f:
            f.write(body)
        os.replace(path + ".tmp", path)

    def get(self, key: str, start: int = 0, size: int | None = None) -> bytes:
        try:
            with open(self.path(key), "rb") as f:
                f.seek(start)
                return f.read(-1 if size is None else size)
        except FileNotFoundError as e:
            raise KeyError(key) from e

    def names(self, prefix: str = "") -> list[str]:
        found = (os.path.relpath(os.path.join(d, f), self.root) for d, _, fs in os.walk(self.root) for f in fs if not f.endswith(".tmp"))
        return sorted(k for k in found if k.startswith(prefix))

    def delete(self, key: str) -> None:
        if os.path.exists(self.path(key)):
            os.remove(self.path(key))


def paths_of(manifest: Manifest) -> list[str]:
    return [manifest.cells.path, manifest.objects.path, *(f.path for fs in (manifest.level_files or {}).values() for f in fs)]


def save(collection: Collection, store: Store, prefix: str) -> list[str]:
    """Copies a collection into a store, its manifest last; the keys in the order they were put."""
    store.delete(f"{prefix}/{NAME}")
    for old in store.names(f"{prefix}/"):
        store.delete(old)
    out = []
    for path in [*paths_of(collection.manifest), NAME]:
        store.put(f"{prefix}/{path}", files.get(collection.spark, f"{collection.prefix}/{path}"))
        out.append(f"{prefix}/{path}")
    return out


def load(spark: SparkSession, store: Store, prefix: str, to: str) -> Collection:
    """Copies a collection out of a store into a folder that Spark reads, and opens it there."""
    try:
        body = store.get(f"{prefix}/{NAME}")
    except KeyError as e:
        raise UnfinishedCollectionError(f"{prefix} has no {NAME}: it was not finished, or is not there") from e
    for path in paths_of(Manifest.from_json(body)):
        files.put(spark, f"{to}/{path}", store.get(f"{prefix}/{path}"))
    files.put(spark, f"{to}/{NAME}", body)
    return Collection(spark, to)
