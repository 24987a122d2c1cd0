"""All registered queries."""

from chainage.plans import aggregates, blocks, crossings, engines, geometry, joins, programme, rows, synthesis, travel, windows  # noqa: F401
from chainage.plans.registry import ORACLES, QUERIES  # noqa: F401
