"""Views over the given tables, registered queries and their SQL."""

from corvane.plans import masks, pictures, precision, queries, reports  # noqa: F401  they register their queries
from corvane.plans.registry import QUERIES, SQL  # noqa: F401
