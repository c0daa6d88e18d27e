"""Training-data operators on Spark: deduplication, scoring, mixing, search.

Nothing outside this folder imports it, so it can be removed whole.
``queries.QUERIES`` and ``queries.ORACLES`` list what it registers.
"""
