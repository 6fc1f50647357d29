"""Registry of the engine's queries and their SQL oracles; importing the plans fills it."""

from lodestone.plans import cases, ranking, scans, search, state, tools
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cases", "ranking", "scans", "search", "state", "tools"]
