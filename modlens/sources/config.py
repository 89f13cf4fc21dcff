"""Rule configuration: which rules run, and with which severity."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.schemas import SEVERITY_RANK


@dataclass(frozen=True)
class RuleConfig:
    """Overrides by rule id: False drops, True keeps, a severity replaces.

    Ids of no rule are ignored.
    """

    rules: Mapping[str, bool | str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for rule_id, setting in self.rules.items():
            if isinstance(setting, bool):
                continue
            # Accepted spellings: low, Low, LOW and so on.
            if not isinstance(setting, str) or setting not in {
                spelling for s in SEVERITY_RANK for spelling in (s, s.lower(), s.upper())
            }:
                raise ValueError(f"{rule_id}: neither true/false nor a severity: {setting!r}")

    def is_enabled(self, rule_id: str) -> bool:
        return self.rules.get(rule_id, True) is not False

    def severity_of(self, rule_id: str) -> str | None:
        setting = self.rules.get(rule_id)
        return setting.capitalize() if isinstance(setting, str) else None

    @classmethod
    def from_json(cls, text: str) -> RuleConfig:
        """A document with an optional ``rules`` object."""
        return cls(json.loads(text).get("rules", {}))

    @classmethod
    def from_toml(cls, text: str) -> RuleConfig:
        """A document with an optional ``[rules]`` table."""
        return cls(tomllib.loads(text).get("rules", {}))

    @classmethod
    def from_dataframe(cls, config: DataFrame, known: list[str]) -> RuleConfig:
        """Rows of ``rule_id, enabled, severity``; for rules in ``known`` only.

        One row per known rule reaches the driver, whatever the size of the table.
        """
        rows = (
            config.filter(F.col("rule_id").isin(known))
            .groupBy("rule_id")
            .agg(
                F.min(F.coalesce("enabled", F.lit(True))).alias("enabled"),
                F.max_by(
                    "severity", F.map_from_arrays(*_rank_arrays())[F.initcap("severity")]
                ).alias("severity"),
            )
            .collect()
        )
        return cls({r.rule_id: (r.severity or True) if r.enabled else False for r in rows})


def _rank_arrays():
    return (
        F.array(*[F.lit(s) for s in SEVERITY_RANK]),
        F.array(*[F.lit(n) for n in SEVERITY_RANK.values()]),
    )
