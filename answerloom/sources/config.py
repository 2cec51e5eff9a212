"""Settings: nested mappings, merged, hashed by section."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path


def deep_merge(base: dict, over: dict | None) -> dict:
    """``base`` with ``over`` laid on it; mappings are merged, everything else is replaced. Neither is changed."""
    out = dict(base)
    for k, v in (over or {}).items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x), ensure_ascii=False)


class Config:
    """A mapping with dotted look-ups and hashes of its sections."""

    def __init__(self, raw: dict | None = None):
        self.raw = raw or {}

    @classmethod
    def load(cls, path: str | Path) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return cls(json.loads(text))
        try:
            import yaml
        except ImportError:
            raise RuntimeError("YAML settings need pyyaml; JSON works without") from None
        return cls(yaml.safe_load(text) or {})

    def get(self, dotted: str, default=None):
        value = self.raw
        for part in dotted.split("."):
            if not isinstance(value, dict) or part not in value:
                return default
            value = value[part]
        return value

    def __getitem__(self, key: str):
        return self.raw[key]

    def with_overrides(self, over: dict | None) -> Config:
        return Config(deep_merge(self.raw, over))

    def section_hash(self, *sections: str) -> str:
        return hashlib.sha1(canonical({s: self.get(s) for s in sections}).encode()).hexdigest()[:12]

    def signature(self, without: tuple[str, ...] = ("themes.curation", "themes.required")) -> str:
        """A hash that edits of themes do not change."""
        raw = json.loads(canonical(self.raw))
        for dotted in without:
            *path, last = dotted.split(".")
            at = raw
            for p in path:
                at = at.get(p, {})
            at.pop(last, None)
        return hashlib.sha1(canonical(raw).encode()).hexdigest()[:12]
