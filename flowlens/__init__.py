"""flowlens — event analytics on Spark DataFrames and Structured Streaming.

Order / payment / inventory event logs become product statistics, hourly
counts, order views, saga states, compacted state tables, dead-letter
analytics, operational metrics and routing decisions. Every operator is a
DataFrame -> DataFrame function; the stateful ones also have a streaming form
in :mod:`flowlens.streaming`.
"""

__all__ = ["session", "operators", "sources", "functions", "plans", "streaming"]
