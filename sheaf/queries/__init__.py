"""The registered queries over the test tables."""

from sheaf.queries import documents, interchange, layout, pages, queues, service, streams, text, tools  # noqa: F401
from sheaf.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
