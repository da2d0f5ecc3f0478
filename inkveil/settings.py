"""Settings of the engine: a frozen record, from keyword arguments, the environment or YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

TYPES = ("PERSON", "EMAIL", "PHONE", "ORGANIZATION", "ADDRESS", "SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH", "URL", "PAN", "AADHAAR", "DIN", "PASSPORT")
#: Which type wins where spans overlap; the higher wins.
PRIORITY = {"EMAIL": 100, "URL": 95, "CREDIT_CARD": 92, "SSN": 91, "AADHAAR": 90, "PAN": 89, "PASSPORT": 88, "DIN": 87, "IP_ADDRESS": 86, "PHONE": 85, "DATE_OF_BIRTH": 80, "ADDRESS": 60, "ORGANIZATION": 40, "PERSON": 30}
TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    types: tuple[str, ...] = TYPES
    seed: str = "inkveil"
    min_score: float = 0.4
    propagate: bool = True
    redact_public: bool = False
    emit_mapping: bool = True
    strict_ipv6: bool = False
    straddle: str = "drop"  # or "clip": what happens to spans across segments
    deny: dict[str, tuple[str, ...]] = field(default_factory=dict)
    allow: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        for t in [*self.types, *self.deny, *self.allow]:
            if t not in TYPES:
                raise ValueError(f"unknown type {t}")

    def but(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, raw: dict) -> Settings:
        """Unknown keys are ignored; types in either case."""
        out: dict = {}
        if raw.get("types"):
            names = raw["types"].split(",") if isinstance(raw["types"], str) else raw["types"]
            out["types"] = tuple(t for t in TYPES if t in {str(n).strip().upper() for n in names})
            if len(out["types"]) != len({str(n).strip().upper() for n in names if str(n).strip()}):
                raise ValueError(f"unknown type in {names}")
        for key in ("seed", "straddle"):
            if raw.get(key):
                out[key] = str(raw[key])
        if raw.get("min_score") is not None:
            out["min_score"] = float(raw["min_score"])
        for key in ("propagate", "redact_public", "emit_mapping", "strict_ipv6"):
            if raw.get(key) is not None:
                out[key] = raw[key] if isinstance(raw[key], bool) else str(raw[key]).strip().lower() in TRUE
        for key in ("deny", "allow"):
            if raw.get(key):
                out[key] = {k.upper(): tuple(v) for k, v in raw[key].items()}
        return cls(**out)

    @classmethod
    def from_env(cls, prefix: str = "INKVEIL_") -> Settings:
        return cls.from_mapping({k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)})

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f) or {})
