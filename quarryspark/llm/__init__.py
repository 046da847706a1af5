"""Training-data operators: thirteen dealt operators and what they share.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when the subpackage is present.
"""
