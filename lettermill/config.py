"""Configuration of an analysis, with the bounds of its values checked."""

import json
import re
from dataclasses import dataclass, field, fields

from lettermill.operators.quality import Thresholds
from lettermill.operators.rules import Rule, rule_pack


@dataclass(frozen=True)
class AnalysisConfig:
    """Read from JSON: ``quality_thresholds``, ``temporal_analysis``, ``classification_rules`` and ``custom_categories``; other sections are ignored."""

    min_completeness: float = 95.0
    max_null_rate: float = 5.0
    peak_detection_threshold: float = 2.0
    rolling_window_days: int = 7
    base_rules: tuple | None = None
    custom_rules: tuple = field(default=())

    def __post_init__(self):
        if not 0 <= self.min_completeness <= 100 or not 0 <= self.max_null_rate <= 100:
            raise ValueError("percentages are from 0 to 100")
        if self.rolling_window_days < 2 or self.peak_detection_threshold <= 0:
            raise ValueError("a rolling window has at least 2 days, and a peak threshold is over 0")

    @classmethod
    def load(cls, path: str) -> "AnalysisConfig":
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    @classmethod
    def of(cls, said: dict) -> "AnalysisConfig":
        flat = said.get("quality_thresholds", {}) | said.get("temporal_analysis", {})
        known = {f.name for f in fields(cls)}

        def pack(section: dict) -> tuple:
            return tuple((n, int(r.get("priority", 10)), r.get("keywords", []), r.get("sender_patterns", []), float(r.get("confidence_threshold", 0.8))) for n, r in section.items())

        base = pack(said["classification_rules"]) if "classification_rules" in said else None
        return cls(**{k: v for k, v in flat.items() if k in known}, base_rules=base, custom_rules=pack(said.get("custom_categories", {})))

    @classmethod
    def of_groups(cls, said: dict) -> "AnalysisConfig":
        """From a pack of pattern groups for sorting or deleting mail: sections ``<name>_patterns`` with keywords, and domains, personal_domains or senders,
        which are plain parts of an address. Groups are tried in the order of the file; ``confidence_threshold`` of a group counts if it is there."""
        groups = [(n.removesuffix("_patterns"), g) for n, g in said.items() if n.endswith("_patterns") and isinstance(g, dict)]
        parts = lambda g: [re.escape(p) for k in ("domains", "personal_domains", "senders") for p in g.get(k, [])]
        return cls(base_rules=tuple((n, i, g.get("keywords", []), parts(g), float(g.get("confidence_threshold", 0.8))) for i, (n, g) in enumerate(groups)))

    def thresholds(self) -> Thresholds:
        return Thresholds(self.min_completeness, self.max_null_rate)

    def rules(self) -> list[Rule]:
        return rule_pack(self.base_rules, self.custom_rules) if self.base_rules is not None else rule_pack(custom=self.custom_rules)
