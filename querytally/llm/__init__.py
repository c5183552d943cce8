"""Operators of a training-data pipeline; nothing else in the package imports them."""

from . import queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
