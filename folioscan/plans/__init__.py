"""Registered queries; importing the modules fills the registry."""

from . import (  # noqa: F401
    attempt_queries,
    book_queries,
    call_queries,
    file_queries,
    page_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
