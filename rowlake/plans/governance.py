"""What is known about operators and runs: capabilities, contracts, statistics, policies, plans and failures."""

from __future__ import annotations

import hmac
import json
import os
import subprocess
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlake.functions.values import col, num
from rowlake.plans.rules import fingerprint
from rowlake.streaming.state import JsonStore

#: What each operator reads, and the relative cost of a step.
CONTRACTS = {
    "transform_rows": ["rows", "rules"], "join_rows": ["left", "right", "left_on", "right_on"], "aggregate_rows": ["rows", "group_by", "aggregates"], "window_rows": ["rows", "order_by", "functions"], "quality_check": ["rows", "rules"], "stream_window": ["rows", "time", "window_ms"],
    "vector_search": ["index", "queries"], "parquet_io": ["path"], "schema_registry": ["name", "version"],
}
COSTS = {"join_rows": 5.0, "aggregate_rows": 4.0, "quality_check": 3.0, "load_rows": 2.0, "save_rows": 2.0}
FAILURES = [("timeout|timed out", "timeout", True, "retry"), ("quota|limit|too many", "quota", True, "backoff"), ("connection|refused|unavailable", "network", True, "retry"), ("schema|type|cast", "schema", False, "fix_input"), ("gate|quality", "quality", False, "review"), ("permission|denied|policy", "policy", False, "escalate")]


def capabilities() -> dict:
    from rowlake.plans.workflow import OPERATORS

    return {"operators": sorted(OPERATORS), "streaming": ["stream_window", "transform_rows"], "contracts": CONTRACTS}


def check_contract(operator: str, given: dict) -> list[str]:
    """The inputs that are missing."""
    return [x for x in CONTRACTS.get(operator, []) if given.get(x) is None]


def classify_failure(error: str) -> dict:
    import re

    for pattern, kind, again, action in FAILURES:
        if re.search(pattern, error, re.I):
            return {"class": kind, "retryable": again, "action": action}
    return {"class": "unknown", "retryable": False, "action": "inspect"}


class RuntimeStats:
    """The last 500 durations of each operator."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def record(self, operator: str, ms: float, rows: int = 0) -> None:
        self.store.put(operator, (self.store.get(operator, []) + [{"ms": ms, "rows": rows}])[-500:])

    def summary(self, operator: str) -> dict:
        s = sorted(x["ms"] for x in self.store.get(operator, []))
        return {"count": len(s), "p50": s[len(s) // 2], "p95": s[min(len(s) - 1, int(0.95 * len(s)))]} if s else {"count": 0}

    def reset(self, operator: str) -> None:
        self.store.delete(operator)

    def regression(self, operator: str, max_p95: float) -> bool:
        return self.summary(operator).get("p95", 0) > max_p95

    def timed(self, operator: str, f: Callable):
        start = time.perf_counter()
        out = f()
        self.record(operator, (time.perf_counter() - start) * 1000)
        return out


class Policies:
    """Quotas of tenants, and lists of allowed and denied operators."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def set(self, tenant: str, **policy) -> None:
        self.store.put(tenant, self.get(tenant) | policy)

    def get(self, tenant: str) -> dict:
        return self.store.get(tenant, {"max_rows": 250_000, "max_steps": 128, "allow": [], "deny": []})

    def reset(self, tenant: str) -> None:
        self.store.delete(tenant)

    def permits(self, tenant: str, operator: str) -> bool:
        p = self.get(tenant)
        return operator not in p["deny"] and (not p["allow"] or operator in p["allow"])


def incremental_plan(previous: dict | None, current: dict, checkpoint: str | None = None) -> dict:
    """cache_reuse if nothing changed, resume_from_checkpoint if there is one, else full_recompute."""
    mark = fingerprint(current)
    same = previous is not None and previous.get("fingerprint") == mark
    return {"fingerprint": mark, "strategy": "cache_reuse" if same else "resume_from_checkpoint" if checkpoint else "full_recompute"}


def advise(rows: int, complexity: int = 0) -> dict:
    """Hints by size; Catalyst and AQE decide."""
    return {"engine": "columnar" if rows >= 20_000 or complexity >= 8 else "row", "join": "sort_merge" if rows >= 100_000 else "hash", "aggregate": "approx_hybrid" if rows >= 60_000 else "exact"}


def explain_plan(steps: list[dict], rows: int, history: dict[str, float] | None = None) -> dict:
    """The estimated cost of each step and of all."""
    each = [{"id": s["id"], "cost": round(COSTS.get(s["type"], 1.0) * (1 + rows / 50_000) * (history or {}).get(s["type"], 1.0), 4)} for s in steps]
    return {"steps": each, "total": round(sum(x["cost"] for x in each), 4)}


def feedback(history: dict[str, float], operator: str, ratio: float) -> dict[str, float]:
    return history | {operator: 0.7 * history.get(operator, 1.0) + 0.3 * ratio}


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


#: Column functions for cell-wise use; register_udf adds others.
CELL: dict[str, Callable[[Column], Column]] = {"identity": lambda c: c, "double": lambda c: num(c) * 2, "negate": lambda c: -num(c), "trim": lambda c: F.trim(c.cast("string")), "upper": lambda c: F.upper(c.cast("string")), "lower": lambda c: F.lower(c.cast("string"))}


def register_udf(name: str, f: Callable[[Column], Column], on_conflict: str = "error") -> None:
    if name in CELL and on_conflict == "error":
        raise ValueError(f"{name} is registered")
    if name not in CELL or on_conflict == "replace":
        CELL[name] = f


def apply_udf(df: DataFrame, field: str, op: str, alias: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """A registered cell function; unknown ones raise."""
    if op not in CELL or (allowed is not None and op not in allowed):
        raise ValueError(f"{op!r} isn't allowed")
    return df.withColumn(alias or field, CELL[op](col(field)))


def apply_udf_signed(df: DataFrame, field: str, op: str, alias: str | None = None, allowed: list[str] | None = None, token: str | None = None, secret: str | None = None) -> DataFrame:
    """apply_udf for a caller whose token is the operation's signature under the secret."""
    if secret and not hmac.compare_digest(token or "", sign(op, secret)):
        raise PermissionError("the token isn't valid")
    return apply_udf(df, field, op, alias, allowed)


def apply_wasm(df: DataFrame, field: str, module: bytes, alias: str | None = None, export: str = "transform_f64") -> DataFrame:
    """A number column through a WASM module's export, in Arrow batches; needs the wasmtime package on the executors, and never falls back to anything else."""
    import wasmtime  # noqa: F401  absent: ImportError here, not in a task

    name = alias or field
    out = df.withColumn(name, col(field).cast("double"))
    at = out.columns.index(name)

    def run(batches):
        import pyarrow as pa
        import wasmtime

        store = wasmtime.Store()
        f = wasmtime.Instance(store, wasmtime.Module(store.engine, module), []).exports(store)[export]
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([None if x is None else f(store, x) for x in batch.column(at).to_pylist()], pa.float64()))

    return out.mapInArrow(run, out.schema)


def sign(text: str, secret: str) -> str:
    return hmac.new(secret.encode(), text.encode(), "sha256").hexdigest()


class Faults:
    """Failures on purpose, for tests: an environment variable `operator:fail` or `operator:timeout`."""

    def __init__(self, variable: str = "ROWLAKE_FAULT", wait_s: float = 0.2):
        self.variable, self.wait_s = variable, wait_s

    def check(self, operator: str) -> None:
        name, _, mode = os.environ.get(self.variable, "").partition(":")
        if not name.strip() or name.strip().lower() != operator.lower():
            return
        if mode.strip().lower() == "timeout":
            time.sleep(self.wait_s)
            raise TimeoutError(f"fault injected timeout: {operator}")
        raise RuntimeError(f"fault injected failure: {operator}")


class Plugins:
    """Commands that read JSON and write JSON: off unless listed; with limits of time, input, output and runs at once a tenant, signatures, a circuit breaker and an audit log."""

    def __init__(self, commands: dict[str, list[str]], enabled: bool = False, timeout_s: float = 20, max_bytes: int = 8 << 20, failures: int = 3, pause_s: float = 30, max_input: int = 1_000_000, at_once: int = 2, secret: str | None = None):
        self.commands, self.enabled, self.timeout_s, self.max_bytes, self.failures, self.pause_s = commands, enabled, min(120, timeout_s), max_bytes, failures, pause_s
        self.max_input, self.at_once, self.secret = max_input, at_once, secret
        self.failed: dict[tuple[str, str], tuple[int, float]] = {}
        self.running: dict[str, int] = {}
        self.audit: list[dict] = []
        self.lock = threading.Lock()

    def manifest(self, name: str) -> dict:
        """What a signature covers."""
        return {"name": name, "command": self.commands[name]}

    def _enter(self, name: str, payload: str, tenant: str, signature: str | None) -> None:
        if not self.enabled or name not in self.commands:
            raise PermissionError(f"plugin {name!r} isn't allowed")
        if self.secret and not hmac.compare_digest(signature or "", sign(json.dumps(self.manifest(name), sort_keys=True), self.secret)):
            raise PermissionError(f"plugin {name!r} isn't signed")
        if len(payload) > self.max_input:
            raise ValueError("the input is too large")
        with self.lock:
            count, since = self.failed.get((tenant, name), (0, 0.0))
            if count >= self.failures and time.monotonic() - since < self.pause_s:
                raise RuntimeError(f"plugin {name!r} is paused after {count} failures")
            if self.running.get(tenant, 0) >= self.at_once:
                raise RuntimeError(f"{tenant} runs {self.at_once} plugins at once already")
            self.running[tenant] = self.running.get(tenant, 0) + 1

    def run(self, name: str, payload, tenant: str = "default", signature: str | None = None) -> object:
        text, start = json.dumps(payload), time.monotonic()
        self._enter(name, text, tenant, signature)
        error = None
        try:
            return _call(self.commands[name], text, self.timeout_s, self.max_bytes)
        except Exception as e:
            error = str(e)[:300]
            raise
        finally:
            with self.lock:
                self.running[tenant] -= 1
                if error is None:
                    self.failed.pop((tenant, name), None)
                else:
                    self.failed[(tenant, name)] = self.failed.get((tenant, name), (0, 0.0))[0] + 1, time.monotonic()
                self.audit = [*self.audit, {"plugin": name, "tenant": tenant, "ok": error is None, "error": error, "ms": round((time.monotonic() - start) * 1000, 1)}][-1000:]

    def apply(self, df: DataFrame, name: str, schema, tenant: str = "default", signature: str | None = None, rows: int = 1000) -> DataFrame:
        """The rows that the command gives for each list of rows, on the executors, `rows` at a time."""
        self._enter(name, "", tenant, signature)
        with self.lock:
            self.running[tenant] -= 1
        command, timeout_s, max_bytes = self.commands[name], self.timeout_s, self.max_bytes
        kind = df.sparkSession.createDataFrame([], schema).schema

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            fields = to_arrow_schema(kind)
            for batch in batches:
                for a in range(0, batch.num_rows, rows):
                    out = _call(command, json.dumps(batch.slice(a, rows).to_pylist(), default=str), timeout_s, max_bytes)
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

        return df.mapInArrow(run, kind)

    def health(self) -> dict[str, bool]:
        return {n: all(c < self.failures for (_, name), (c, _) in self.failed.items() if name == n) for n in self.commands}


def _call(command: list[str], text: str, timeout_s: float, max_bytes: int):
    out = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout_s, check=True).stdout
    if len(out) > max_bytes:
        raise ValueError("the output is too large")
    return json.loads(out)


class RuleSets:
    """Named sets of quality rules, with a version for each change."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def save(self, name: str, rules: dict, note: str = "") -> dict:
        return self.store.update(name, lambda old: {"name": name, "rules": rules, "note": note, "fingerprint": fingerprint(rules), "version": (old or {"version": 0})["version"] + 1})

    def get(self, name: str) -> dict:
        found = self.store.get(name)
        if found is None:
            raise KeyError(name)
        return found

    def list(self) -> list[dict]:
        return [{k: x[k] for k in ("name", "version", "fingerprint")} for x in (self.store.get(n) for n in self.store.keys())]

    def delete(self, name: str) -> bool:
        return self.store.delete(name)


class Reviews:
    """Decisions that people take: a run and node wait, then are approved or rejected, once."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def ask(self, run: str, node: str, note: str = "") -> dict:
        return self.store.update(f"{run}--{node}", lambda old: old or {"run": run, "node": node, "note": note, "status": "pending", "reviewer": None, "comment": ""})

    def decide(self, run: str, node: str, approved: bool, reviewer: str, comment: str = "") -> dict:
        def change(old):
            if old is None:
                raise KeyError(f"{run} {node}")
            if old["status"] != "pending":
                raise ValueError(f"{run} {node} is {old['status']}")
            return {**old, "status": "approved" if approved else "rejected", "reviewer": reviewer, "comment": comment}

        return self.store.update(f"{run}--{node}", change)

    def list(self, status: str | None = None) -> list[dict]:
        return [x for x in (self.store.get(k) for k in self.store.keys()) if x and status in (None, x["status"])]


class Baselines:
    """Metrics of a run that later runs are held against."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def save(self, name: str, metrics: dict[str, float]) -> None:
        self.store.put(name, metrics)

    def compare(self, name: str, metrics: dict[str, float], tolerance: float = 0.1) -> list[dict]:
        """The metrics that differ from the baseline by more than the tolerance, relative to it."""
        base = self.store.get(name)
        if base is None:
            raise KeyError(name)
        rows = [{"metric": k, "baseline": v, "value": metrics.get(k), "change": None if metrics.get(k) is None else (metrics[k] - v) / abs(v) if v else float(metrics[k] != v)} for k, v in base.items()]
        return [r for r in rows if r["change"] is None or abs(r["change"]) > tolerance]


class Apps:
    """Published workflows by name and version; each version stays as it was."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def publish(self, name: str, definition: dict, params: dict | None = None) -> int:
        return self.store.update(name, lambda old: [*(old or []), {"version": len(old or []) + 1, "definition": definition, "params": params or {}, "fingerprint": fingerprint(definition)}])[-1]["version"]

    def get(self, name: str, version: int | None = None) -> dict:
        found = self.store.get(name) or []
        pick = [x for x in found if version in (None, x["version"])]
        if not pick:
            raise KeyError(f"{name} {version or ''}")
        return pick[-1]

    def diff(self, name: str, a: int, b: int) -> dict:
        """Nodes added, removed and changed between two versions."""
        one, two = ({n["id"]: n for n in self.get(name, v)["definition"].get("nodes", [])} for v in (a, b))
        return {"added": sorted(set(two) - set(one)), "removed": sorted(set(one) - set(two)), "changed": sorted(k for k in set(one) & set(two) if one[k] != two[k])}

    def list(self) -> dict[str, int]:
        return {k: len(self.store.get(k, [])) for k in self.store.keys()}
