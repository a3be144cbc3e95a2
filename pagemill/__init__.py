"""pagemill: landed pages, nested JSON and work tables into clean records, on Spark."""

from pagemill.session import configure, scratch_path

__all__ = ["configure", "scratch_path"]
