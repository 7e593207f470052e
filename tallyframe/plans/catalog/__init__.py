"""The query catalogue: importing it fills the registry."""

from tallyframe.plans.catalog import balances, classification, dashboard, quality, registers, sources, streams, summaries, transfers  # noqa: F401
from tallyframe.plans.registry import ORACLES, QUERIES  # noqa: F401
