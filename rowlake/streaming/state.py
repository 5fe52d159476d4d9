"""Named state with versions, and delivery records: small JSON documents below a folder.

A document is only ever created, under a name that says its version, and creation fails where the name is taken. So of
two writers one wins, without a lock, on a disk as in a folder of any file system of Spark's whose creation is
exclusive, as HDFS's is (a URI with its scheme, which all drivers of a cluster share). Nothing is read and written again
to add a record.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(ValueError):
    pass


class _Local:
    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def create(self, name: str, data: bytes) -> bool:
        """False if the name is taken; the document appears whole or not at all."""
        path = self.folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        draft = path.parent / f".new-{uuid.uuid4().hex}"
        draft.write_bytes(data)
        try:
            os.link(draft, path)
        except FileExistsError:
            return False
        finally:
            draft.unlink()
        return True

    def read(self, name: str) -> bytes | None:
        try:
            return (self.folder / name).read_bytes()
        except FileNotFoundError:
            return None

    def delete(self, name: str) -> bool:
        try:
            (self.folder / name).unlink()
            return True
        except FileNotFoundError:
            return False

    def names(self, sub: str = "") -> list[str]:
        folder = self.folder / sub
        return sorted(p.name for p in folder.iterdir() if p.is_file() and not p.name.startswith(".")) if folder.is_dir() else []


class _Shared:
    """The same through the file systems that Spark knows."""

    def __init__(self, folder: str):
        self.spark = SparkSession.active()
        self.base, jvm = folder.rstrip("/"), self.spark._jvm
        self.fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def create(self, name: str, data: bytes) -> bool:
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return True

    def read(self, name: str) -> bytes | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self._path(name), False))

    def names(self, sub: str = "") -> list[str]:
        path = self._path(sub)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(".")) if self.fs.exists(path) else []


class JsonStore:
    """A JSON document for each key, with versions from 1; the last of them counts. Older ones are deleted once a newer is there."""

    def __init__(self, folder: str):
        path = re.sub(r"^file:(?://)?(?=/)", "", folder)  # Hadoop's own creation isn't exclusive on disks
        self.files = _Shared(folder) if "://" in path else _Local(path)

    def _versions(self, key: str) -> list[int]:
        if not re.fullmatch(r"[A-Za-z0-9_.@-]{1,128}", key) or key.startswith("."):
            raise ValueError(f"not a key: {key!r}")
        return sorted(int(m[1]) for n in self.files.names(key) if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def version(self, key: str) -> int:
        return max(self._versions(key), default=0)

    def get(self, key: str, default=None):
        for v in reversed(self._versions(key)):
            raw = self.files.read(f"{key}/v{v}.json")
            if raw:  # else just deleted, or being written
                return json.loads(raw)["value"]
        return default

    def put_if(self, key: str, value, expected: int) -> bool:
        """Writes version expected + 1, unless there is one already or the last isn't `expected`."""
        versions = self._versions(key)
        if max(versions, default=0) != expected:
            return False
        if not self.files.create(f"{key}/v{expected + 1}.json", json.dumps({"value": value}, sort_keys=True).encode()):
            return False
        for v in versions[:-1]:  # the one before stays for readers that have seen its name
            self.files.delete(f"{key}/v{v}.json")
        return True

    def update(self, key: str, change, default=None, tries: int = 100):
        """value = change(value), again if another writer came first."""
        for _ in range(tries):
            expected = self.version(key)
            value = change(self.get(key, default))
            if self.put_if(key, value, expected):
                return value
        raise VersionConflict(f"{key} changes too often")

    def put(self, key: str, value) -> None:
        self.update(key, lambda _: value)

    def delete(self, key: str) -> bool:
        return any([self.files.delete(f"{key}/v{v}.json") for v in reversed(self._versions(key))])

    def keys(self) -> list[str]:
        if isinstance(self.files, _Local):
            found = [p.name for p in self.files.folder.iterdir() if p.is_dir()]
        else:
            found = [s.getPath().getName() for s in self.files.fs.listStatus(self.files._path("")) if s.isDirectory()]
        return sorted(k for k in found if re.fullmatch(r"[A-Za-z0-9_@-][A-Za-z0-9_.@-]*", k) and self._versions(k))


class StreamState:
    """save, load, delete and list of {state, offset, version, updated_at}; save checks the version that the caller expects, and of two writers one wins."""

    def __init__(self, folder: str, max_late_ms: int | None = None):
        self.store, self.max_late_ms = JsonStore(folder), max_late_ms

    def load(self, key: str) -> dict | None:
        return self.store.get(key)

    restore = load

    def save(self, key: str, state: dict, offset: int = 0, expected_version: int | None = None, event_ms: int | None = None, now_ms: int | None = None) -> dict:
        now = int(time.time() * 1000) if now_ms is None else now_ms
        late = event_ms is not None and self.max_late_ms is not None and now - event_ms > self.max_late_ms
        while True:
            there = self.store.version(key)
            old = self.store.get(key) or {"version": 0}
            if late:
                return {**old, "dropped_late": True}
            if expected_version is not None and expected_version != old["version"]:
                raise VersionConflict(f"{key} has version {old['version']}, not {expected_version}")
            new = {"state": state, "offset": offset, "version": old["version"] + 1, "updated_at": now}
            if self.store.put_if(key, new, there):
                return new
            if expected_version is not None:
                raise VersionConflict(f"{key} was written by another")

    def delete(self, key: str) -> bool:
        return self.store.delete(key)

    def list(self) -> list[str]:
        return self.store.keys()


class Reliability:
    """Delivery records of a stream: message ids seen, messages that failed, checkpoints. A record is a document of its own, found by the hash of its id."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def _create(self, stream: str, kind: str, message_id: str, value) -> bool:
        self.store._versions(stream)  # checks the name
        return self.store.files.create(f"{stream}.{kind}/{hashlib.sha1(message_id.encode()).hexdigest()}", json.dumps(value).encode())

    def _all(self, stream: str, kind: str) -> list[str]:
        return self.store.files.names(f"{stream}.{kind}")

    def record(self, stream: str, message_id: str, payload=None, error: str | None = None) -> dict:
        """Takes a message once, whoever brings it; a failed one goes to the failed messages."""
        if not self._create(stream, "seen", message_id, error is None):
            self.store.files.create(f"{stream}.repeats/{uuid.uuid4().hex}", b"{}")
            return {"duplicate": True, "failed": False}
        if error:
            self._create(stream, "failed", message_id, {"id": message_id, "payload": payload, "error": error, "at": time.time()})
        return {"duplicate": False, "failed": bool(error)}

    def checkpoint(self, stream: str, offset: int) -> None:
        self.store.put(stream, {"checkpoint": offset})

    def replay(self, stream: str, limit: int = 100) -> list[dict]:
        found = [json.loads(self.store.files.read(f"{stream}.failed/{n}") or b"{}") for n in self._all(stream, "failed")]
        return [{k: x[k] for k in ("id", "payload", "error")} for x in sorted((x for x in found if x), key=lambda x: x["at"])][:limit]

    def flush(self, stream: str) -> int:
        return sum(self.store.files.delete(f"{stream}.failed/{n}") for n in self._all(stream, "failed"))

    def stats(self, stream: str) -> dict:
        seen, failed, repeats = (len(self._all(stream, k)) for k in ("seen", "failed", "repeats"))
        return {"seen": seen, "failed": failed, "repeats": repeats, "checkpoint": self.store.get(stream, {"checkpoint": 0})["checkpoint"], "consistent": seen >= failed}


class DeliveryTable:
    """The same for whole batches: ids seen, a Parquet table in buckets of their hash, so that a batch is held against its own buckets only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _seen(self) -> DataFrame:
        return self.spark.read.schema("id string, batch string, bucket int").parquet(f"{self.path}/seen")

    def take(self, messages: DataFrame, key: str, batch: str) -> DataFrame:
        """The messages whose ids are new, one row for each; they are recorded under the batch's name. A batch that is repeated after a failure gives the same again."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/seen")
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(jpath)
        marked = messages.filter(F.col(f"`{key}`").isNotNull()).withColumn("__id", F.col(f"`{key}`").cast("string")).withColumn("__bucket", F.pmod(F.xxhash64("__id"), F.lit(self.buckets)).cast("int"))
        before = self._seen().filter(F.col("batch") != batch).select(F.col("id").alias("__id"), F.col("bucket").alias("__bucket"))
        new = marked.join(before, ["__id", "__bucket"], "left_anti").dropDuplicates(["__id"])
        new.select(F.col("__id").alias("id"), F.lit(batch).alias("batch"), F.col("__bucket").alias("bucket")).join(self._seen().filter(F.col("batch") == batch).select("id"), "id", "left_anti").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/seen")
        return new.drop("__id", "__bucket")
