"""Everything that is registered."""

from twinproof.plans import change_plans, fleet_plans, load_plans, monitor_plans, parity, schema_plans, stream_plans, watch_plans  # noqa: F401
from twinproof.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
