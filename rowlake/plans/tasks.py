"""Transforms as tasks: submitted once per idempotency key, run under a Spark job group, retried, cancelled, cached."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from rowlake.plans.rules import fingerprint


class Tasks:
    """states: queued, running, done, failed, cancelled."""

    def __init__(self, spark: SparkSession, slots: int = 4, retries: int = 1):
        self.spark, self.retries, self.pool = spark, retries, ThreadPoolExecutor(slots)
        self.tasks: dict[str, dict] = {}
        self.by_key: dict[str, str] = {}
        self.lock = threading.Lock()

    def submit(self, work, idempotency_key: str | None = None) -> str:
        """work() runs in a thread under its own job group; a known key gives the task that has it."""
        with self.lock:
            if idempotency_key and idempotency_key in self.by_key:
                return self.by_key[idempotency_key]
            name = uuid.uuid4().hex[:12]
            self.tasks[name] = {"id": name, "state": "queued", "attempts": 0, "result": None, "error": None, "cancel": False}
            if idempotency_key:
                self.by_key[idempotency_key] = name
        self.tasks[name]["future"] = self.pool.submit(self._run, name, work)
        return name

    def _run(self, name: str, work) -> None:
        task = self.tasks[name]
        for _ in range(self.retries + 1):
            if task["cancel"]:
                task["state"] = "cancelled"
                return
            task["state"], task["attempts"] = "running", task["attempts"] + 1
            self.spark.sparkContext.setJobGroup(name, f"task {name}", interruptOnCancel=True)
            try:
                task["result"], task["state"], task["error"] = work(), "done", None
                return
            except Exception as e:
                task["error"], task["state"] = str(e)[:500], "cancelled" if task["cancel"] else "failed"

    def status(self, name: str) -> dict:
        return {k: v for k, v in self.tasks[name].items() if k not in ("future", "cancel")}

    def wait(self, name: str, timeout_s: float = 600) -> dict:
        self.tasks[name]["future"].result(timeout_s)
        return self.status(name)

    def cancel(self, name: str) -> None:
        self.tasks[name]["cancel"] = True
        self.spark.sparkContext.cancelJobGroup(name)


def input_stamp(df: DataFrame) -> str:
    """The files that a plan reads, with their sizes and times: another stamp where one of them has changed."""
    spark = df.sparkSession
    conf, found = spark._jsc.hadoopConfiguration(), []
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        status = fs.getFileStatus(path) if fs.exists(path) else None
        found.append([name, status.getLen(), status.getModificationTime()] if status else [name])
    return fingerprint(sorted(found))


class ResultCache:
    """Cached DataFrames by plan and rules: `ttl_s` long, `most` of them, the least recently used goes first.

    An entry counts only if its plan is the same one (hashes may be equal for others) and its input files haven't changed.
    """

    def __init__(self, ttl_s: float = 600, most: int = 256):
        self.ttl_s, self.most = ttl_s, most
        self.kept: OrderedDict[str, list[tuple[float, DataFrame, str, DataFrame]]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, df: DataFrame, rules: dict, make, stamp: str | None = None) -> DataFrame:
        """make(df) under the rules, or what it gave before. stamp says the state of the input; by default its files do."""
        key, now = f"{df.semanticHash()}-{fingerprint(rules)}", time.monotonic()
        stamp = input_stamp(df) if stamp is None else stamp
        valid = []
        for entry in self.kept.get(key, []):
            if now - entry[0] < self.ttl_s and (entry[2] == stamp or not entry[1].sameSemantics(df)):
                valid.append(entry)
            else:
                entry[3].unpersist()
        self.kept[key] = valid
        self.kept.move_to_end(key)
        for _, plan, _, result in valid:
            if plan.sameSemantics(df):
                self.hits += 1
                return result
        self.misses += 1
        valid.append((now, df, stamp, make(df).cache()))
        while sum(map(len, self.kept.values())) > self.most:
            oldest = next(iter(self.kept))
            for entry in self.kept.pop(oldest):
                entry[3].unpersist()
        return valid[-1][3]

    def clear(self) -> int:
        n = sum(map(len, self.kept.values()))
        for entries in self.kept.values():
            for entry in entries:
                entry[3].unpersist()
        self.kept.clear()
        return n

    def stats(self) -> dict:
        return {"entries": sum(map(len, self.kept.values())), "hits": self.hits, "misses": self.misses}
