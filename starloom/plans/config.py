"""Configuration: nested sections, dotted keys, typed reads with defaults, overrides, JSON files."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any


class Config:
    def __init__(self, values: dict[str, Any] | None = None):
        self._tree: dict[str, Any] = copy.deepcopy(values or {})

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls(json.loads(Path(path).read_text()))

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self._tree, indent=2, sort_keys=True))

    def _find(self, key: str) -> tuple[bool, Any]:
        at: Any = self._tree
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return False, None
            at = at[part]
        return True, at

    def has(self, key: str) -> bool:
        return self._find(key)[0]

    def get(self, key: str, default: Any = None) -> Any:
        """The value, or ``default`` where it is missing or of another type than the default's."""
        there, value = self._find(key)
        if not there:
            return default
        if default is None or isinstance(value, type(default)) and isinstance(value, bool) == isinstance(default, bool):
            return value
        if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
            return float(value)
        return default

    def set(self, key: str, value: Any) -> None:
        *parents, last = key.split(".")
        at = self._tree
        for part in parents:
            nxt = at.setdefault(part, {})
            if not isinstance(nxt, dict):
                raise ValueError(f"{part} of {key} is a value, not a section")
            at = nxt
        at[last] = value

    def merge(self, other: Config) -> Config:
        """A new configuration, with the other's values where both have one."""

        def into(a: dict, b: dict) -> dict:
            out = dict(a)
            for k, v in b.items():
                out[k] = into(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
            return out

        return Config(into(self._tree, other._tree))

    def validate(self, schema: dict[str, type]) -> list[str]:
        """What is missing or of a wrong type."""
        wrong = []
        for key, kind in schema.items():
            there, value = self._find(key)
            if not there:
                wrong.append(f"{key} is missing")
            elif not isinstance(value, kind):
                wrong.append(f"{key} is not {kind.__name__}")
        return wrong

    def summary(self) -> str:
        """Every value with its dotted key, one a line."""

        def lines(at: dict, path: str) -> list[str]:
            return [x for k, v in sorted(at.items()) for x in (lines(v, f"{path}{k}.") if isinstance(v, dict) else [f"{path}{k}: {v}"])]

        return "\n".join(lines(self._tree, ""))
