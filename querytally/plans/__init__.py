"""Registered queries over the given tables."""

from . import catalog, descriptions, evaluation, relational, storage  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
