"""Provider billing analytics on Spark."""

from .session import build_session

__all__ = ["build_session"]
