"""Training-data operators: ten corpus operators, their queries and their SQL.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds
its queries only when it can be imported.
"""
