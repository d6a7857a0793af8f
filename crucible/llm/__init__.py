"""Training-data operators on Spark: scoring, near and substring duplicates, leaks, archives, token counts, mixing, quality.

Each module holds one operator; ``queries`` registers one query for each.
"""
