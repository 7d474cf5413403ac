"""Imports every module that registers queries."""

from ..functions import queries as functions  # noqa: F401
from ..operators import engine_queries, hydrology, ledger, log_queries, producer_queries, raster_queries, read_models, relational  # noqa: F401
from ..sources import queries as sources  # noqa: F401
from ..streaming import queries as streaming  # noqa: F401
