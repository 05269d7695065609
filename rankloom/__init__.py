"""Recommendation-data engine on Spark DataFrames.

Layers, from the bottom up:

* ``functions``  column expressions (hashing, vector arithmetic, losses)
* ``sources``    readers, writers and the binding of star-schema tables to ratings
* ``operators``  one module per family of DataFrame operators
* ``plans``      multi-stage jobs that string operators together
* ``catalog``    named queries with their SQL counterparts
"""

__version__ = "0.1.0"
