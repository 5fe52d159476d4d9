"""Named functions that users add: field transforms, row filters, stages and flows, and the modules that register them."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator


class Registry:
    """Functions by name. on_conflict: error, replace, keep, or warn, which replaces and notes it in `conflicts`."""

    def __init__(self, kind: str):
        self.kind, self.known, self.conflicts = kind, {}, []

    def register(self, name: str, f: Callable, on_conflict: str = "error", domain: str = "custom") -> Callable:
        name = name.strip().lower()
        if not name or not callable(f):
            raise ValueError(f"a {self.kind} needs a name and a function")
        if on_conflict not in ("error", "replace", "keep", "warn"):
            raise ValueError(f"no policy {on_conflict!r}")
        if name in self.known:
            if on_conflict == "error":
                raise ValueError(f"the {self.kind} {name} is registered")
            if on_conflict == "warn":
                self.conflicts.append(name)
            if on_conflict == "keep":
                return self.known[name][0]
        self.known[name] = f, domain
        return f

    def unregister(self, name: str) -> bool:
        return self.known.pop(name.strip().lower(), None) is not None

    def get(self, name: str) -> Callable:
        try:
            return self.known[name.strip().lower()][0]
        except KeyError:
            raise KeyError(f"no {self.kind} {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name.strip().lower() in self.known

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.known))

    def domains(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for name in self:
            out.setdefault(self.known[name][1], []).append(name)
        return out


#: f(column, spec) -> Column
FIELD_TRANSFORMS = Registry("field transform")
#: f(df, spec) -> Column that is true for the rows that stay
ROW_FILTERS = Registry("row filter")
#: f(df, spec) -> DataFrame
STAGES = Registry("stage")
FLOWS = Registry("flow")


class Extensions:
    """Modules that register functions when they are imported; named, or listed with commas in an environment variable."""

    def __init__(self, variable: str = "ROWLAKE_EXTENSIONS"):
        self.variable, self.loaded, self.failed = variable, [], {}

    def configured(self) -> list[str]:
        return [x.strip() for x in os.environ.get(self.variable, "").split(",") if x.strip()]

    def load(self, names: list[str] | None = None, again: bool = False) -> dict:
        """Imports what isn't loaded yet; a module that fails is noted and doesn't stop the others."""
        for name in self.configured() if names is None else names:
            if name in self.loaded and not again:
                continue
            try:
                module = importlib.import_module(name)
                if again and name in self.loaded:
                    importlib.reload(module)
            except Exception as e:
                self.failed[name] = str(e)
                continue
            self.failed.pop(name, None)
            if name not in self.loaded:
                self.loaded.append(name)
        return {"configured": self.configured(), "loaded": list(self.loaded), "failed": dict(self.failed)}
