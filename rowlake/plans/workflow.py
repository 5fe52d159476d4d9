"""Workflows: a graph of operators over lazy DataFrames; nothing is materialised between steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.functions.expressions import fields_of
from rowlake.functions.values import col
from rowlake.operators import aggregates, claims, enrichment, filters, intelligence, joins, papers, quality, text, transform, windows
from rowlake.plans.governance import Faults
from rowlake.streaming import windows as streams


class WorkflowError(ValueError):
    pass


def _on(f: Callable) -> Callable:
    return lambda inputs, config: f(inputs["rows"], **config)


#: Operator types of workflow nodes; register() adds others.
OPERATORS: dict[str, Callable] = {
    "transform_rows": lambda i, c: transform.transform(i["rows"], c["rules"], c.get("order_by"), filter_expr=c.get("filter_expr"), computed=c.get("computed")).df,
    "join_rows": lambda i, c: joins.join_rows_prefiltered(i["left"], i["right"], **{"enable_bloom": False, **c}), "diff_audit": lambda i, c: joins.diff_audit(i["left"], i["right"], **c),
    "aggregate_rows": _on(aggregates.aggregate_stats), "window_rows": _on(windows.window_rows), "time_series": _on(windows.time_series), "forecast": _on(windows.forecast), "quality_check": _on(quality.quality_check), "constraints": _on(quality.constraint_violations), "columnar_eval": _on(filters.columnar_eval),
    "query_lang": _on(filters.query_lang), "chart_data": _on(aggregates.chart_data), "text_preprocess": _on(text.preprocess), "chunk": _on(text.chunk), "entity_extract": _on(text.extract_entities), "entity_link": _on(text.link_entities), "conflicts": _on(text.detect_conflicts), "stream_window": _on(streams.stream_window),
    "finance_ratio": _on(intelligence.finance_ratios), "anomaly_explain": _on(intelligence.explain_anomalies), "fact_crosscheck": _on(intelligence.crosscheck_facts), "normalize_schema": _on(transform.normalize_schema), "profile": _on(aggregates.profile),
}


def _clean_md(inputs: dict, config: dict) -> DataFrame:
    """The text without markup of links, code and emphasis, and without blank lines in a row."""
    name = config.get("text", "text")
    x = F.regexp_replace(F.regexp_replace(col(name).cast("string"), r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^```.*$|[*_`]{1,3}", "")
    return inputs["rows"].withColumn(name, F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n")))


def _markdown(inputs: dict, config: dict) -> DataFrame:
    """A `markdown` column: a line of a table for each row, its columns in their order."""
    rows = inputs["rows"]
    cells = [F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in config.get("fields", rows.columns)]
    return rows.withColumn("markdown", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def _review(inputs: dict, config: dict) -> DataFrame:
    """The rows with review_status: pending, or what was decided; `store` is a governance.Reviews."""
    found = config["store"].ask(config["run"], config.get("node", "review"), config.get("note", ""))
    if found["status"] == "rejected":
        raise WorkflowError(f"{found['node']} was rejected by {found['reviewer']}")
    return inputs["rows"].withColumn("review_status", F.lit(found["status"]))


def _ingest(inputs: dict, config: dict) -> DataFrame:
    from rowlake.sources.load import load_many

    out, failed = load_many(config["spark"], config["sources"], config.get("on_error", "raise"))
    if out is None:
        raise WorkflowError(f"nothing was read of {', '.join(failed)}")
    return out


OPERATORS |= {
    "sql_chart": _on(aggregates.chart_first_seen), "compute_metrics": _on(aggregates.text_metrics), "clean_md": _clean_md, "md_output": _markdown, "manual_review": _review, "ingest_files": _ingest, "stats": _on(intelligence.stats_columns), "image_report": _on(quality.image_report),
    "clean_rows": _on(papers.clean_rows), "clean_chunks": _on(papers.clean_chunks), "preprocess_rows": _on(enrichment.preprocess_rows), "canonical_evidence": _on(claims.canonical_evidence), "claim_conflicts": _on(claims.mark_conflicts), "evidence_report": _on(claims.evidence_report),
}


def register(name: str, f: Callable[[dict, dict], DataFrame], on_conflict: str = "error") -> None:
    if name in OPERATORS and on_conflict == "error":
        raise WorkflowError(f"{name} is registered")
    if name not in OPERATORS or on_conflict == "replace":
        OPERATORS[name] = f


def order(definition: dict) -> list[dict]:
    """The nodes so that each comes after its inputs, otherwise by id. Raises for unknown types, ids and cycles."""
    nodes = {}
    for n in definition.get("nodes", []):
        if n["id"] in nodes:
            raise WorkflowError(f"node {n['id']} occurs twice")
        if n["type"] not in OPERATORS:
            raise WorkflowError(f"unknown operator {n['type']!r}")
        nodes[n["id"]] = n
    waits: dict[str, set[str]] = {k: set() for k in nodes}
    for e in definition.get("edges", []):
        if e["from"] not in nodes or e["to"] not in nodes:
            raise WorkflowError(f"edge {e['from']} -> {e['to']} has no node")
        if e.get("when") and e["when"].get("op", "eq") != "eq":
            raise WorkflowError("only eq conditions are known")
        waits[e["to"]].add(e["from"])
    out: list[dict] = []
    while waits:
        ready = sorted(k for k, w in waits.items() if not w)
        if not ready:
            raise WorkflowError(f"a cycle through {', '.join(sorted(waits))}")
        out.append(nodes[ready[0]])
        del waits[ready[0]]
        for w in waits.values():
            w.discard(ready[0])
    return out


def _resolve(value, context: dict):
    if isinstance(value, str) and value.startswith("$"):
        name = value[1:].removesuffix(".rows")
        if name not in context:
            raise WorkflowError(f"{value} isn't known")
        return context[name]
    return value


def reference_run(definition: dict, inputs: dict[str, DataFrame], params: dict | None = None, **options) -> dict:
    """run, after the contract of the whole definition: its errors are raised before any step is planned."""
    from rowlake.plans.contracts import check_workflow

    report = check_workflow(definition, **options)
    if not report["ok"]:
        raise WorkflowError("; ".join(e["message"] for e in report["errors"]))
    return {**run(report["workflow"], inputs, params), "notes": report["notes"]}


def run(definition: dict, inputs: dict[str, DataFrame], params: dict | None = None, limit: int = 128) -> dict:
    """Node outputs by id and a trace. A node reads config.input_map ({rows: "$other"}), else its single edge, else the input `rows`."""
    steps = order(definition)
    if len(steps) > limit:
        raise WorkflowError(f"more than {limit} steps")
    context: dict = {**inputs}
    trace: list[dict] = []
    skipped: set[str] = set()
    for node in steps:
        edges = [e for e in definition.get("edges", []) if e["to"] == node["id"]]
        off = any(e["from"] in skipped or e.get("when") and (params or {}).get(e["when"]["field"]) != e["when"]["value"] for e in edges)
        if off:
            skipped.add(node["id"])
            trace.append({"id": node["id"], "status": "skipped"})
            continue
        config = dict(node.get("config", {}))
        mapped = config.pop("input_map", None) or ({"rows": f"${edges[0]['from']}"} if edges else {"rows": "$rows"})
        try:
            Faults().check(node["type"])
            context[node["id"]] = OPERATORS[node["type"]]({k: _resolve(v, context) for k, v in mapped.items()}, config)
            trace.append({"id": node["id"], "status": "done"})
        except Exception as e:
            trace.append({"id": node["id"], "status": "failed", "error": str(e)[:300]})
            return {"outputs": {k: v for k, v in context.items() if k not in inputs}, "trace": trace, "ok": False}
    return {"outputs": {k: v for k, v in context.items() if k not in inputs}, "trace": trace, "ok": True}


def lineage(computed: dict[str, object], sources: list[str] = (), steps: dict | None = None) -> list[dict]:
    """Edges from fields to computed fields, columns of sources, and steps to the steps before them."""
    out = [{"from": f, "to": name, "kind": "field"} for name, e in computed.items() for f in sorted(fields_of(e))]
    out += [{"from": s, "to": "rows", "kind": "source"} for s in sources]
    return out + [{"from": e["from"], "to": e["to"], "kind": "step"} for e in (steps or {}).get("edges", [])]


