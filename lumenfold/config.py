"""Parameters of the matching core."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """power: sharpening exponent; threshold: inclusive, on the relative score; top_k: rows kept per source.

    assume_normalized: skip the norms and take the dot product as the cosine.
    max_broadcast_values: numbers (rows x dimension) up to which the target side is broadcast.
    """

    power: float = 5.5
    threshold: float = 0.68
    top_k: int | None = 10
    assume_normalized: bool = True
    max_broadcast_values: int = 8_000_000

    def __post_init__(self):
        if not self.power > 0 or not 0 <= self.threshold <= 1 or (self.top_k is not None and self.top_k < 1):
            raise ValueError(f"bad matching parameters: {self}")

    @classmethod
    def from_file(cls, path: str) -> MatchConfig:
        """The parameters in a JSON, TOML or (where a YAML reader is installed) YAML file.

        embedding: dtype float32, normalized true. matching: similarity cosine, negative_clamp, power_transform (exponent),
        normalization per source, threshold (relative, >=), top_k (null: all). A missing field, or a
        value that the matching doesn't implement, is an error that names all of them.
        """
        with open(path, "rb") as f:
            raw = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(raw)
        else:
            found = tomllib.loads(raw.decode()) if path.endswith(".toml") else json.loads(raw)
        if not isinstance(found, dict):
            raise ValueError(f"{path}: not an object")
        try:
            e, m = found["embedding"], found["matching"]
            fixed = {
                "embedding.dtype": (e["dtype"], "float32"), "embedding.normalized": (e["normalized"], True), "matching.similarity": (m["similarity"], "cosine"), "matching.negative_clamp": (m["negative_clamp"], {"enabled": True, "value": 0.0}),
                "matching.power_transform.enabled": (m["power_transform"]["enabled"], True), "matching.normalization": (m["normalization"], {"method": "l_infinity", "scope": "per_source_rule"}),
                "matching.threshold.type": (m["threshold"]["type"], "relative"), "matching.threshold.operator": (m["threshold"]["operator"], ">="),
            }
            own = cls(float(m["power_transform"]["exponent"]), float(m["threshold"]["value"]), m["top_k"])
        except (KeyError, TypeError) as x:
            raise ValueError(f"{path}: missing field {x}") from x
        if bad := [name for name, (value, known) in fixed.items() if value != known]:
            raise ValueError(f"{path}: unsupported " + ", ".join(bad))
        return own
