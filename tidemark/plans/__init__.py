"""The operators bound to tables: `commerce`, `scouting` and the modules after them register queries, `oracles` their SQL."""

from . import commerce, oracles, prospects, ranking, scouting, seasons

__all__ = ["commerce", "oracles", "prospects", "ranking", "scouting", "seasons"]
