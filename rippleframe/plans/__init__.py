"""Registered queries, grouped by topic. Importing this package fills the registry."""

from rippleframe.plans.registry import REGISTRY  # noqa: F401
from rippleframe.plans import (  # noqa: F401
    windows,
    state,
    spectral,
    matching,
    codecs,
    decisions,
    models,
    streams,
    templates,
    composites,
    updates,
    rolling,
    ranging,
    shared,
)
