"""orbitlake: Earth-observation analytics over Spark tables."""

from .registry import QueryError, register_index
from .session import materialise, session

__all__ = ["QueryError", "materialise", "register_index", "session"]
