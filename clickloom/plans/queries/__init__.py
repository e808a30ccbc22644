"""Registered queries, one per operator; importing this package fills the registry."""

from . import (  # noqa: F401
    encodings,
    ensembles,
    history,
    horizontal,
    joins,
    learning,
    metrics,
    projection,
    sequences,
    splits,
    storage,
    streams,
    temporal,
    whole_plans,
)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
