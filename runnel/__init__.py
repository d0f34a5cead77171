"""Runnel: ordered stream-dataflow analytics on Spark DataFrames.

A program is built from combinators over :class:`Stream`, a DataFrame with an
explicit dense ``seq`` column.  Every operator is an ordinary lazy DataFrame
transformation, so Catalyst sees and optimises the whole graph.
"""

from .session import get_session
from .stream import Stream

__all__ = ["Stream", "get_session"]
