"""The registered queries and the SQL that each is held against."""

from samewise.plans import blocks, clusters, learning, measures, relations, targeted, texts  # noqa: F401
from samewise.plans.registry import ORACLES, QUERIES  # noqa: F401
