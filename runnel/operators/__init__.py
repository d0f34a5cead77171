"""Operators on ordered streams: maps, rates, windows, state, splitters, joiners."""

from .maps import become, become_when, decimate, expand, explode_each, map_stream, route, take, where, zip_streams
from .splitjoin import (
    feedback,
    identity,
    join_rr,
    pipeline,
    split_duplicate,
    split_rr,
    splitjoin,
)
from .state import keyed_fold, ordered_fold, running
from .windows import fir, peek

__all__ = [
    "become", "become_when", "decimate", "expand", "explode_each", "feedback", "fir", "identity", "join_rr", "keyed_fold",
    "map_stream", "ordered_fold", "peek", "pipeline", "route", "running", "split_duplicate", "split_rr",
    "splitjoin", "take", "where", "zip_streams",
]
