"""Settings of the two jobs, checked when made."""

from __future__ import annotations

import os
from dataclasses import dataclass

from quarry.operators.prng import SEED
from quarry.schemas import MAX_CLUSTERS, NPROBE


def _number(env: dict, name: str, default: int) -> int:
    text = env.get(name, "")
    try:
        return int(text) if text else default
    except ValueError:
        raise ValueError(f"{name} is no whole number: {text}") from None


@dataclass(frozen=True)
class BuildConfig:
    clusters: int = 512
    iterations: int = 10
    seed: int = SEED

    def __post_init__(self):
        if not 0 < self.clusters <= MAX_CLUSTERS:
            raise ValueError(f"clusters must be from 1 to {MAX_CLUSTERS}")
        if self.iterations <= 0:
            raise ValueError("iterations must be positive")
        if not 0 <= self.seed < 1 << 64:
            raise ValueError("the seed must be an unsigned 64-bit number")

    @classmethod
    def from_env(cls, env: dict | None = None) -> BuildConfig:
        env = os.environ if env is None else env
        return cls(_number(env, "QUARRY_CLUSTERS", 512), _number(env, "QUARRY_ITERATIONS", 10), _number(env, "QUARRY_SEED", SEED))


@dataclass(frozen=True)
class ScoreConfig:
    index_path: str = "index"
    nprobe: int = NPROBE
    refine: bool = True

    def __post_init__(self):
        if not self.index_path.strip():
            raise ValueError("an index path is needed")
        if self.nprobe <= 0:
            raise ValueError("nprobe must be positive")

    @classmethod
    def from_env(cls, env: dict | None = None) -> ScoreConfig:
        env = os.environ if env is None else env
        return cls(env.get("QUARRY_INDEX", "index"), _number(env, "QUARRY_NPROBE", NPROBE), env.get("QUARRY_REFINE", "true").lower() != "false")
