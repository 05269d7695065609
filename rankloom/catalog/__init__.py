"""Named queries over a star-schema folder, and the same results stated in SQL."""

from rankloom.catalog import storage  # noqa: F401 - adds its queries
from rankloom.catalog.oracles import ORACLES
from rankloom.catalog.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
