"""Registered queries by name, and their SQL twins."""

from .plans import contents, documents, fixtures, lookups, markup, pages, records, stores, texts  # noqa: F401
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
