"""Every registered query of the engine, with its SQL where SQL can express it."""

from . import facts, numeric, questions, retrieval, state  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
