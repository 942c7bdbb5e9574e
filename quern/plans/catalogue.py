"""All registered queries of the reference's operators and their SQL."""

from quern.plans import ordered, relational, round_trips, scalar  # noqa: F401  (they register themselves)
from quern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
