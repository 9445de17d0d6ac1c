"""Reusable plan shapes: staged tables, hot-key splits, running totals, global ranks."""

from .ladder import attach_by_value, ladder, numbered, totals_before
from .rectangles import count_in_ranges
from .running import paired, running
from .skew import HotKeys, find_hot
from .stage import clear, discard, passing, shuffles_removed, stage, together

__all__ = [
    "HotKeys",
    "attach_by_value",
    "clear",
    "count_in_ranges",
    "discard",
    "find_hot",
    "ladder",
    "numbered",
    "paired",
    "passing",
    "running",
    "shuffles_removed",
    "stage",
    "together",
    "totals_before",
]
