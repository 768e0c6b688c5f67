"""Operators for building training corpora: secrets, tokens, de-duplication, quality, search and packing.

Nothing else in the package imports this subpackage; ``QUERIES`` and ``ORACLES`` are read by the entry point.
"""

from lapspark.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
