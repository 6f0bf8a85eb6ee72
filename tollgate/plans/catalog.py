"""Imports every plan module so that all query keys are registered."""

from __future__ import annotations

from . import browse, jobs, reports, stored, streams  # noqa: F401
from .registry import REGISTRY


def queries():
    return {k: q.fn for k, q in REGISTRY.items()}


def oracles():
    return {k: q.oracle for k, q in REGISTRY.items() if q.oracle}
