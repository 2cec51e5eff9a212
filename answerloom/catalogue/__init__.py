"""All queries of the library, and the SQL that checks them."""

from __future__ import annotations

from . import ratings, texts, vectors
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ratings", "texts", "vectors"]
