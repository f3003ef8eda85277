"""paddock: Spark-native analytics for panels of competitive events.

Each row of a panel is one entity (runner) in one group (race) on one date,
with a market price, a result and a free-text comment.  Everything here is a
DataFrame plan: row-level work stays on the executors, only fitted parameters
and small result tables reach the driver.
"""

from paddock.session import get_spark

__all__ = ["get_spark"]
