"""Typed failures; ``category`` is what a result row carries as error_category."""

from __future__ import annotations


class EngineError(Exception):
    category = "fatal"


class ManifestMismatch(EngineError):
    """The stored index was built from other data or by other settings."""


class OrphanChunks(EngineError):
    """Chunks whose document is not in the corpus."""


class StaleIndex(EngineError):
    """The lexical index and the chunks don't hold the same ids."""


class CategoryDrift(EngineError):
    """Advertised categories that the corpus doesn't have."""


class DuplicateKey(EngineError):
    """A key that has to be unique is not."""


class BadVectors(EngineError):
    """Vectors that are not finite, have no length or another dimension."""


class BadRequest(EngineError):
    category = "rephrase"


class ModelUnavailable(EngineError):
    category = "retryable"
