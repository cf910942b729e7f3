"""Training-data preparation operators.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only while it can be found.
"""
