"""The queries of the library."""

from millrace.plans import analytics, derived, graphs, labels, ranking, texts  # noqa: F401
from millrace.plans.registry import QUERIES, SQL  # noqa: F401
