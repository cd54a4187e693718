"""Models and tokenizers that a worker loads once, and the failures of loading and asking them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..errors import ModelUnavailable
from .rerank import yes_probability

_HELD: dict[str, Any] = {}


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """What ``load`` gives, kept by this process under ``name``; a missing file or library is ``ModelUnavailable``."""
    if name not in _HELD:
        try:
            _HELD[name] = load()
        except Exception as e:  # libraries have failures of their own
            raise ModelUnavailable(f"{name} can't be loaded: {e}") from e
    return _HELD[name]


@dataclass(frozen=True)
class FileTokenizer:
    """A tokenizer file of the ``tokenizers`` library; tasks carry its path and load it once a process."""

    path: str

    def encode(self, text: str) -> list[int]:
        return self._own().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._own().decode(ids)

    def _own(self):
        def load():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(self.path)

        return loaded(self.path, load)


@dataclass(frozen=True)
class LoadedEmbedder:
    """An embedder made on the worker by ``make``; what it raises when asked is ``ModelUnavailable``."""

    name: str
    dim: int
    make: Callable[[], Any] = field(repr=False)

    def embed(self, texts: list[str], task: str) -> np.ndarray:
        own = loaded(self.name, self.make)
        try:
            return own.embed(texts, task)
        except (OSError, MemoryError, RuntimeError) as e:
            raise ModelUnavailable(f"{self.name} failed: {e}") from e


#: Fixed value: how a pair is put to a model that answers yes or no.
PAIR = "<Instruct>: {instruction}\n<Query>: {query}\n<Document>: {text}"


@dataclass(frozen=True)
class YesNoReranker:
    """A cross-encoder as a reranker: ``make`` gives, on the worker, a function from pairs to their (no, yes) logits."""

    name: str
    instruction: str
    make: Callable[[], Callable[[list[str]], np.ndarray]] = field(repr=False)

    def rerank(self, query: str, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        model = loaded(self.name, self.make)
        try:
            logits = np.asarray(model([PAIR.format(instruction=self.instruction, query=query, text=t) for t in texts]), np.float64)
        except (OSError, MemoryError, RuntimeError) as e:
            raise ModelUnavailable(f"{self.name} failed: {e}") from e
        return yes_probability(logits[:, 0], logits[:, 1])
