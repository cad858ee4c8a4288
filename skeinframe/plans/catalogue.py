"""All registered queries of the library's own operators."""

from skeinframe.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
