"""Crisis message analytics as Spark jobs."""

from tocsin.config import DEFAULTS, VERSION, Settings

__all__ = ["DEFAULTS", "VERSION", "Settings"]
