"""Training-data pipeline operators.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
