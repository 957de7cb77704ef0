"""Named queries over the given tables."""

from . import classifier, cohorts, embedding, files, maps, variants  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
