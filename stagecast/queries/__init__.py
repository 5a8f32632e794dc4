"""The operators bound to the driver's tables, each with the SQL it is checked against."""

from stagecast.queries import comparison, episodes, live, modelling, readings, sources, streams, upstream
from stagecast.queries.bindings import REGISTRY

__all__ = ["REGISTRY", "comparison", "episodes", "live", "modelling", "readings", "sources", "streams", "upstream"]
