"""A query for each operator and program, and the same in SQL."""

from . import stream_queries  # noqa: F401  registers its queries
from .queries import ORACLES, QUERIES  # noqa: F401
