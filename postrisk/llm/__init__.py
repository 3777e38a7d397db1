"""Operators of a training-data pipeline (numbered 1 to 10) and their queries.

Nothing outside this subpackage imports it; ``queries.QUERIES`` lists what
``__spark_entry__.py`` registers."""
