"""Queries over the test tables that run the package's operators, each with its SQL where SQL can express it."""

from .reference import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
