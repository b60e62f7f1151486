"""Named queries over the test tables, each with the SQL that defines its result."""

from tidewatch.catalog import data, evaluation, history, learning
from tidewatch.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data", "evaluation", "history", "learning"]
