"""The line language of transform rules, versioned rule packages, cleaning specifications and canonical profiles."""

from __future__ import annotations

import hashlib
import json
import re

from rowlake.plans.headers import ALIASES, map_header, token
from rowlake.streaming.state import JsonStore

_OPS = [("<=", "lte"), (">=", "gte"), ("==", "eq"), ("!=", "ne"), (">", "gt"), ("<", "lt")]


def compile_rules(text: str) -> dict:
    """rename a -> b; cast f: type; required f; filter f OP value; # begins a comment."""
    out: dict = {"rename_map": {}, "casts": {}, "required_fields": [], "filters": []}
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        word, _, rest = line.partition(" ")
        if word == "rename" and "->" in rest:
            a, b = (x.strip() for x in rest.split("->", 1))
            out["rename_map"][a] = b
        elif word == "cast" and ":" in rest:
            a, b = (x.strip() for x in rest.split(":", 1))
            out["casts"][a] = b
        elif word == "required" and rest.strip():
            out["required_fields"].append(rest.strip())
        elif word == "filter" and (hit := next(((s, op) for s, op in _OPS if s in rest), None)):
            a, b = (x.strip() for x in rest.split(hit[0], 1))
            value: object = b.strip("'\"")
            if re.fullmatch(r"-?\d+(?:\.\d+)?", b):
                value = float(b) if "." in b else int(b)
            out["filters"].append({"field": a, "op": hit[1], "value": value})
        else:
            raise ValueError(f"line {n}: {raw.strip()!r}")
    return out


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class RulePackages:
    """Rules under name and version, with a fingerprint."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def publish(self, name: str, version: str, rules: dict) -> str:
        mark = fingerprint(rules)
        self.store.put(f"{name}__{version}", {"name": name, "version": version, "rules": rules, "fingerprint": mark})
        return mark

    def get(self, name: str, version: str) -> dict:
        found = self.store.get(f"{name}__{version}")
        if found is None:
            raise KeyError(f"{name} {version}")
        if fingerprint(found["rules"]) != found["fingerprint"]:
            raise ValueError("the package was changed")
        return found


#: The canonical profiles.
PROFILES = {
    "finance_statement": {"required": ["id", "amount"], "numeric": ["id", "amount"], "date": ["biz_date", "published_at"], "unique": ["id"]},
    "bank_statement": {"required": ["account_no", "txn_date"], "numeric": ["debit_amount", "credit_amount", "amount", "balance"], "date": ["txn_date"], "unique": ["account_no", "txn_date", "ref_no", "amount"]},
    "customer_contact": {"required": ["customer_name", "phone"], "numeric": [], "date": [], "unique": ["phone"]},
    "customer_ledger": {"required": ["customer_name", "phone", "amount", "biz_date"], "numeric": ["amount"], "date": ["biz_date"], "unique": ["phone", "biz_date", "amount"]},
    "debate_evidence": {"required": ["claim_text", "source_path"], "numeric": ["confidence"], "date": ["published_at"], "unique": ["source_path", "speaker", "source_domain", "claim_text"]},
}


def map_headers(headers: list[str], mode: str = "strict", profile: str | None = None, samples: dict[str, list] | None = None) -> dict[str, tuple[str | None, float]]:
    """header -> (field, confidence), by headers.map_header."""
    found = {h: map_header(h, mode, PROFILES.get(profile or ""), (samples or {}).get(h, ())) for h in headers}
    return {h: (x["field"], x["confidence"]) for h, x in found.items()}


def recommend_profile(headers: list[str], mode: str = "strict") -> list[dict]:
    """The profiles by score: coverage of required fields .55, share of matched headers .25, mean confidence .20, less .08 if several headers stand for one required field."""
    out = []
    for name, p in PROFILES.items():
        own = {*p["required"], *p["numeric"], *p["date"], *p["unique"]}
        mapped = {}
        for h in headers:  # of the fields that a header may stand for, one of the profile's own
            options = [f for f, names in ALIASES.items() if token(h) in (token(x) for x in [f, *names])]
            mine = next((f for f in options if f in own), None)
            x = map_header(h, mode, p)
            if not mine and x["field"] not in own and len(token(h)) > 1:  # a short header that is a part of a name of one of them
                x = next(({"field": f, "confidence": 0.88} for f, names in ALIASES.items() if f in own and any(token(h) in token(y) for y in names)), x)
            mapped[h] = (mine, 1.0) if mine else (x["field"], x["confidence"])
        hits = [c for f, c in mapped.values() if f in own]
        fields = [f for f, _ in mapped.values() if f in p["required"]]
        coverage = len(set(fields)) / len(p["required"])
        score = 0.55 * coverage + 0.25 * len(hits) / max(1, len(headers)) + 0.20 * (sum(hits) / len(hits) if hits else 0) - (0.08 if len(fields) > len(set(fields)) else 0)
        out.append({"profile": name, "score": round(max(0.0, score), 4), "required_coverage": coverage, "recommended": coverage == 1.0 or score >= 0.78, "mapping": {h: f for h, (f, _) in mapped.items()}})
    ledger = next(x for x in out if x["profile"] == "customer_ledger")
    first = {"customer_ledger": 0} if {"amount", "biz_date"} <= {*ledger["mapping"].values()} else {}
    return sorted(out, key=lambda x: (-x["score"], first.get(x["profile"], 1), x["profile"]))


def cleaning_spec(profile: str, headers: list[str], overrides: dict | None = None) -> dict:
    """A transform rule set of a profile for these headers: renames, casts, required fields, dates and deduplication."""
    p = PROFILES[profile]
    renames: dict[str, str] = {}
    mapping = next(x for x in recommend_profile(headers) if x["profile"] == profile)["mapping"]
    for h, f in mapping.items():
        if f and f != h and f not in headers and f not in renames.values():
            renames[h] = f
    fields = {renames.get(h, h) for h in headers}
    rules = {
        "rename_map": renames, "casts": {f: "int" if f == "id" else "float" for f in p["numeric"] if f in fields}, "required_fields": [f for f in p["required"] if f in fields], "date_ops": [{"field": f, "op": "parse_ymd"} for f in p["date"] if f in fields],
        "deduplicate_by": [f for f in p["unique"] if f in fields], "null_values": ["null", "none", "na", "n/a"],
    }
    return rules | (overrides or {})


def guard(headers: list[str], profile: str, metrics: dict | None = None) -> dict:
    """allow, warn or block a cleaning run before it starts."""
    best = recommend_profile(headers)[0]
    mine = next(x for x in recommend_profile(headers) if x["profile"] == profile)
    reasons = []
    if metrics and metrics.get("passed_rows") == 0:
        return {"action": "block", "reasons": ["no row would be left"]}
    if mine["required_coverage"] < 1:
        reasons.append("required fields have no header")
    if best["profile"] != profile and best["recommended"]:
        reasons.append(f"{best['profile']} fits better")
    return {"action": "block" if mine["required_coverage"] == 0 else "warn" if reasons else "allow", "reasons": reasons}
