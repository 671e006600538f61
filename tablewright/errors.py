"""Errors that a caller can act on."""

from __future__ import annotations


class DataLoadError(ValueError):
    """The input cannot be read as a table."""


class FeatureConfigError(ValueError):
    """The feature configuration does not fit the table or is not valid."""


class TrainingError(ValueError):
    """A run cannot be trained: bad target, unknown algorithm, too little data."""


class ScoringError(ValueError):
    """The records to score do not carry the features the model needs."""


class RegistryError(ValueError):
    """A registry operation is not allowed."""
