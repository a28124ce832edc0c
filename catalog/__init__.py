"""Queries over the driver tables, one per operator, with equivalent SQL.

``QUERIES`` maps a name to a function of (session, table folder); ``ORACLE``
maps the same name to SQL over views of the same tables, where SQL can say it.
"""

from catalog import base, columns, community, joins, measures, scalars, summaries
from catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "base", "columns", "community", "joins", "measures", "scalars", "summaries"]
