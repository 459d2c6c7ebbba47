"""Training-data pipeline operators (ten operators and their queries).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when
it is there.
"""
