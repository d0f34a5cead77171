"""Graphs of operators, and the catalogue of registered queries."""

from .graph import Program, check_rates, to_dot

__all__ = ["Program", "check_rates", "to_dot"]
