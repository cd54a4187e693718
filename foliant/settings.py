"""Typed settings with their defaults; ``from_env`` reads overrides with a prefix, from the environment and a ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


def env_file(path: str = ".env") -> dict[str, str]:
    """``NAME=value`` lines of a file, values without their quotes; none if it isn't there. Blank lines and comments are skipped."""
    out = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, equals, value = line.removeprefix("export ").partition("=")
                if equals and not line.startswith("#"):
                    value = value.strip()
                    quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                    out[name.strip()] = value[1:-1] if quoted else value
    return out


#: Settings that may be 0: each switches something off.
MAY_BE_ZERO = ("min_body_length", "overlap")


class _FromEnv:
    @classmethod
    def from_env(cls, prefix: str, env: dict[str, str] | None = None):
        """Defaults, then the ``.env`` file of the working directory, then the environment (or ``env`` alone)."""
        env = env_file() | os.environ if env is None else env
        own = cls()
        found = {}
        for f in fields(own):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(getattr(own, f.name))
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return replace(own, **found)

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, bool) and isinstance(value, int | float) and (value < 0 or value == 0 and f.name not in MAY_BE_ZERO):
                raise ValueError(f"{f.name} has to be positive")


@dataclass(frozen=True)
class RetrievalSettings(_FromEnv):
    embedding_dim: int = 1024
    embedding_model: str = "hashing"
    min_body_length: int = 100
    max_tokens: int = 450
    overlap: int = 50
    search_k: int = 5
    rrf_k: int = 60
    rrf_vector_weight: float = 15.0
    rrf_bm25_weight: float = 1.0
    title_weight: float = 10.0
    text_weight: float = 1.0
    hyphen_tokens: bool = False
    rerank_fetch_k: int = 50
    hybrid_pool: int = 50
    eval_overfetch: int = 5


@dataclass(frozen=True)
class AgentSettings(_FromEnv):
    max_iterations: int = 8
    wall_clock_s: float = 120.0
    hop_timeout_s: float = 30.0
    tool_result_token_budget: int = 4000
    max_history: int = 10
    max_question_chars: int = 1000
    max_answer_chars: int = 4000
