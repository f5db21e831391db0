"""The library's queries over the driver's tables, and their SQL."""

from . import image_queries, match_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
