"""Named queries over the test tables; importing this package registers them."""

from . import (  # noqa: F401
    landscape_queries,
    prediction_queries,
    record_queries,
    rollout_queries,
    source_queries,
    text_queries,
    token_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
