"""What a workflow definition must look like before it is run: identity, nodes, edges, and the settings of each node by its operator."""

from __future__ import annotations

import re

VERSION = "1.0.0"
TEXT, NUMBER, BOOL, LIST, OBJECT, COUNT = "text", "number", "boolean", "list", "object", "count"
_KINDS = {TEXT: lambda x: isinstance(x, str) and x.strip() != "", NUMBER: lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), BOOL: lambda x: isinstance(x, bool), LIST: lambda x: isinstance(x, list), OBJECT: lambda x: isinstance(x, dict), COUNT: lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 1}

#: The settings of an operator: name -> (kind, whether it must be there, allowed values or None). Keys may be a text or a list of texts.
SETTINGS: dict[str, dict[str, tuple]] = {
    "transform_rows": {"rules": (OBJECT, True, None), "order_by": (LIST, False, None), "computed": (LIST, False, None)},
    "join_rows": {"left_on": ((TEXT, LIST), True, None), "right_on": ((TEXT, LIST), True, None), "join_type": (TEXT, False, ["inner", "left", "right", "full", "semi", "anti"]), "enable_bloom": (BOOL, False, None), "strategy": (TEXT, False, ["auto", "sort_merge", "hash", "broadcast"])},
    "diff_audit": {"on": (LIST, True, None), "order_by": (TEXT, False, None)},
    "aggregate_rows": {"group_by": (LIST, True, None), "aggregates": (LIST, True, None)},
    "window_rows": {"partition_by": (LIST, True, None), "order_by": (TEXT, True, None), "functions": (LIST, True, None)},
    "time_series": {"time_field": (TEXT, True, None), "value_field": (TEXT, True, None), "window": (COUNT, False, None)},
    "forecast": {"time_field": (TEXT, True, None), "value_field": (TEXT, True, None), "horizon": (COUNT, False, None), "method": (TEXT, False, ["naive_drift", "naive_last"])},
    "quality_check": {"rules": (OBJECT, True, None), "version": (NUMBER, False, [1, 2, 3, 4])},
    "constraints": {"constraints": (LIST, True, None)},
    "columnar_eval": {"where": (OBJECT, False, None), "select": (LIST, False, None), "limit": (COUNT, False, None)},
    "query_lang": {"text": (TEXT, True, None)},
    "chart_data": {"category": (TEXT, True, None), "series": (TEXT, True, None), "value": (TEXT, True, None), "top_n": (COUNT, False, None)},
    "sql_chart": {"order_by": (TEXT, True, None), "category": (TEXT, False, None), "series": (TEXT, False, None), "value": (TEXT, False, None)},
    "chunk": {"text": (TEXT, True, None), "mode": (TEXT, False, ["none", "paragraph", "sentence", "fixed"]), "max_chars": (COUNT, False, None)},
    "stream_window": {"time": (TEXT, True, None), "window_ms": (COUNT, True, None), "window_type": (TEXT, False, ["tumbling", "sliding", "session"]), "slide_ms": (COUNT, False, None), "gap_ms": (COUNT, False, None)},
}
#: The entries of lists: what each must have, and the values that a key may have.
ENTRIES = {
    ("aggregate_rows", "aggregates"): (["op"], {}), ("window_rows", "functions"): (["op", "as"], {"op": ["row_number", "rank", "dense_rank", "lag", "lead", "moving_avg"]}), ("constraints", "constraints"): (["kind"], {"kind": ["sum_equals", "non_negative"]}), ("transform_rows", "computed"): (["expr"], {}),
}


def _error(path: str, code: str, message: str) -> dict:
    return {"path": path, "code": code, "message": message}


def check_node(kind: str, config: dict, path: str = "config") -> list[dict]:
    """What is wrong with the settings of one node; operators without a contract may have any."""
    out = []
    for name, (want, needed, values) in SETTINGS.get(kind, {}).items():
        x, at = config.get(name), f"{path}.{name}"
        if x is None:
            out += [_error(at, "required", f"{at} is required")] if needed else []
            continue
        kinds = want if isinstance(want, tuple) else (want,)
        if not any(_KINDS[k](x) for k in kinds):
            out.append(_error(at, f"type_{kinds[0]}", f"{at} must be {' or '.join(kinds)}"))
            continue
        if values is not None and x not in values:
            out.append(_error(at, "enum_not_allowed", f"{at} must be one of {', '.join(map(str, values))}"))
        must, may = ENTRIES.get((kind, name), ([], {}))
        for i, entry in enumerate(x if isinstance(x, list) else []):
            if not must:
                break
            if not isinstance(entry, dict):
                out.append(_error(f"{at}[{i}]", "type_object", f"{at}[{i}] must be object"))
                continue
            out += [_error(f"{at}[{i}].{k}", "required", f"{at}[{i}].{k} is required") for k in must if entry.get(k) in (None, "")]
            out += [_error(f"{at}[{i}].{k}", "enum_not_allowed", f"{at}[{i}].{k} must be one of {', '.join(v)}") for k, v in may.items() if entry.get(k) not in (None, "") and str(entry[k]).lower() not in v]
    return out


def check_workflow(definition, migrate: bool = False, need_nodes: bool = False, scope: str = "run") -> dict:
    """{ok, errors, notes, workflow, resolutions}: the errors with path, code and message, and the definition with what was filled in.

    scope draft leaves unknown operators to later; run does not. migrate fills in a version that is missing.
    """
    from rowlake.plans.workflow import OPERATORS, WorkflowError, order

    errors, notes, seen = [], [], []
    if not isinstance(definition, dict):
        return {"ok": False, "errors": [_error("workflow", "type_object", "workflow must be object")], "notes": [], "workflow": {}, "resolutions": []}
    flow = {**definition}
    if not str(flow.get("workflow_id") or "").strip():
        errors.append(_error("workflow.workflow_id", "required", "workflow.workflow_id is required"))
    if not str(flow.get("version") or "").strip():
        if migrate:
            flow["version"] = VERSION
            notes.append(f"workflow.version became {VERSION}")
        else:
            errors.append(_error("workflow.version", "required", "workflow.version is required"))
    elif not re.fullmatch(r"\d+(?:\.\d+){0,2}", str(flow["version"])):
        errors.append(_error("workflow.version", "format", "workflow.version must be numbers with dots"))
    for part in ("nodes", "edges"):
        if not isinstance(flow.get(part, []), list) or part == "nodes" and "nodes" not in flow:
            errors.append(_error(f"workflow.{part}", "type_list", f"workflow.{part} must be list"))
            flow[part] = []
    if need_nodes and not flow["nodes"]:
        errors.append(_error("workflow.nodes", "empty", "workflow.nodes must not be empty"))
    resolutions = []
    for i, node in enumerate(flow["nodes"]):
        at = f"workflow.nodes[{i}]"
        if not isinstance(node, dict):
            errors.append(_error(at, "type_object", f"{at} must be object"))
            continue
        errors += [_error(f"{at}.{k}", "required", f"{at}.{k} is required") for k in ("id", "type") if not str(node.get(k) or "").strip()]
        if node.get("id") in seen:
            errors.append(_error(f"{at}.id", "duplicate", f"node {node['id']} occurs twice"))
        seen.append(node.get("id"))
        known = node.get("type") in OPERATORS
        resolutions.append({"id": node.get("id"), "type": node.get("type"), "known": known})
        if not known and scope == "run" and node.get("type"):
            errors.append(_error(f"{at}.type", "unknown_operator", f"unknown operator {node['type']!r}"))
        config = node.get("config", {})
        errors += check_node(str(node.get("type")), config, f"{at}.config") if isinstance(config, dict) else [_error(f"{at}.config", "type_object", f"{at}.config must be object")]
    for i, edge in enumerate(flow.get("edges", [])):
        at = f"workflow.edges[{i}]"
        for k in ("from", "to"):
            if not isinstance(edge, dict) or edge.get(k) not in seen:
                errors.append(_error(f"{at}.{k}", "unknown_node", f"{at}.{k} names no node"))
    if not errors and scope == "run":
        try:
            order(flow)
        except WorkflowError as e:
            errors.append(_error("workflow", "graph", str(e)))
    return {"ok": not errors, "errors": errors, "notes": notes, "workflow": flow, "resolutions": resolutions}
