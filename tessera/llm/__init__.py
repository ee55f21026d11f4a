"""Training-data operators: ten stand-alone corpus operators and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds
``tessera.llm.queries`` only when the subpackage is present.
"""
