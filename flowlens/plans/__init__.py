"""Query catalog: every registered operator as (Spark builder, oracle SQL).

Importing this package registers all catalog modules.
"""

from flowlens.plans.registry import ORACLE, QUERIES, register  # noqa: F401
from flowlens.plans import (  # noqa: F401  (registration side effects)
    q_stats,
    q_deadletter,
    q_state,
    q_projections,
    q_ops,
    q_routing,
    q_inventory,
    q_sources,
    q_streaming,
    q_keyed,
)
