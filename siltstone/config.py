"""Settings of a plan: defaults, strict reading of a mapping, validation, digest."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, fields

from .functions import constants as K
from .functions.estimator import Estimator, resolve
from .operators.manifest import canonical
from .operators.score import Settings


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=lambda: dict(K.WEIGHTS))
    dampener_enabled: bool = True
    dampener_floor: float = K.DAMPENER_FLOOR
    dampener_slope: float = K.DAMPENER_SLOPE
    exclude: tuple[str, ...] = ()
    disable_defaults: bool = False
    budget: int = 0
    reserve: dict[str, int] = field(default_factory=lambda: dict(K.RESERVE))
    blocking: tuple[str, ...] = ()
    min_feasibility: float | None = None
    fail_on_gaps: bool = False
    model: str = ""
    #: Paths of rank tables by encoding; not part of the digest, as they change with the place alone.
    token_tables: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Config:
        """Defaults with values over them; unknown keys are an error, exclusions are joined to those given before."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        held = dict(values)
        for name in ("exclude", "blocking"):
            if name in held:
                held[name] = tuple(sorted(set(held[name])))
        return cls(**held)

    def scoring(self) -> Settings:
        return Settings(dict(self.weights), self.dampener_floor, self.dampener_slope, self.dampener_enabled)

    def estimator(self) -> Estimator:
        return resolve(self.model, self.token_tables)

    def effective_budget(self) -> int:
        return max(0, self.budget - sum(self.reserve.values()))

    def digest(self) -> str:
        return "sha256:" + hashlib.sha256(canonical({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k != "token_tables"}).encode()).hexdigest()
