"""The registered queries, with the SQL that they are held against."""

from . import packet_queries, text_queries, stream_queries  # noqa: F401, I001  these register their queries, in this order
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
