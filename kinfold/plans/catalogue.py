"""Query catalogue of the engine's own operators."""

from kinfold.plans import catalogue_ingest, catalogue_matching, catalogue_stats  # noqa: F401
from kinfold.plans._registry import ORACLE_SQL, QUERIES  # noqa: F401
