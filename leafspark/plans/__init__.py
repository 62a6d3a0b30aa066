"""Queries of the driver contract over converted documents, and payload writers for them."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
