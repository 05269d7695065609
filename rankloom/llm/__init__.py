"""Operators for training text: search, deduplication, screening, tokens, shards.

Nothing else in the library imports this package. ``QUERIES`` and ``ORACLES`` are what
``__spark_entry__`` adds to the catalogue when the package is present.
"""

from rankloom.llm.oracles import ORACLES
from rankloom.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
