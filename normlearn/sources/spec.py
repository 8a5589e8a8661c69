"""Training parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

APPROACHES = ("m", "s", "sr", "f", "fsql", "t", "auto")
ALGORITHMS = ("bgd", "cgd", "lbfgs", "lbfgs_compat")


@dataclass(frozen=True)
class TrainSpec:
    """What to train and how.  ``w_init`` is the start value of every coefficient."""

    model: str = "dense_logit"
    approach: str = "auto"
    algo: str = "bgd"
    iters: int = 20
    w_init: float = 0.01
    stepsize: float = 1.0
    regularizer: float = 0.1
    tolerance: float | None = None
    srsplits: int | None = None
    grow: float = 1.2  # an accepted step is enlarged by this
    restart: bool = False  # CGD: fall back to steepest descent where the direction does not descend
    max_trials: int = 60
    strict_fk: bool = False
    verbose: bool = False

    def __post_init__(self) -> None:
        if self.model != "dense_logit":
            raise ValueError(f"unknown model {self.model!r}")
        if self.approach not in APPROACHES:
            raise ValueError(f"unknown approach {self.approach!r}; one of {APPROACHES}")
        if self.algo not in ALGORITHMS:
            raise ValueError(f"unknown algo {self.algo!r}; one of {ALGORITHMS}")
        if self.approach == "sr" and not self.srsplits:
            raise ValueError("approach 'sr' needs srsplits")
        if self.iters < 0 or self.stepsize <= 0 or self.regularizer < 0:
            raise ValueError("iters and regularizer must not be negative and stepsize must be positive")

    def with_(self, **changes: Any) -> TrainSpec:
        return replace(self, **changes)


def from_mapping(values: Mapping[str, Any]) -> TrainSpec:
    """A spec from names and values; names it does not have are an error."""
    known = {f.name for f in fields(TrainSpec)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown parameters {unknown}")
    return TrainSpec(**values)


def from_json(path: str) -> TrainSpec:
    with open(path) as f:
        return from_mapping(json.load(f))


def from_arguments(arguments: Sequence[str]) -> TrainSpec:
    """``algo iters w_init stepsize regularizer [tolerance]`` for training over one flat table."""
    if not 5 <= len(arguments) <= 6:
        raise ValueError("expected: algo iters w_init stepsize regularizer [tolerance]")
    algo, iters, w_init, stepsize, regularizer, *rest = arguments
    tolerance = float(rest[0]) if rest else None
    return TrainSpec(
        approach="t", algo=algo, iters=int(iters), w_init=float(w_init), stepsize=float(stepsize),
        regularizer=float(regularizer), tolerance=tolerance,
    )
