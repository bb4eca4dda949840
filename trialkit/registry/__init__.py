"""One query per operator over the test tables, each with its SQL statement where SQL can say it."""

from trialkit.registry import events, models, patients, relational, scalars, study, tables  # noqa: F401
from trialkit.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
