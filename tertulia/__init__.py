"""tertulia — short-text sentiment analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` or ``Column -> Column``
so it composes with ``df.transform`` / ``df.select`` and stays inside
Catalyst; Python runs inside tasks only for batch scoring by external models.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming", "session"]
