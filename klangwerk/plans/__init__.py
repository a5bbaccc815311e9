"""Named queries over the driver's tables."""

from . import corpus, functions, generation, more, phonetic, quality, relational, retrieval, rules
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "functions", "generation", "more", "phonetic", "quality", "relational", "retrieval", "rules"]
