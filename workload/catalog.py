"""Imports every query module so that the registry is complete."""

from . import detections, ledger, matching, outcomes, plans, signals  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
