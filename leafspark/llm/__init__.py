"""Training-data operators over document tables.

Nothing else in the library imports this subpackage; queries and SQL live in
:mod:`leafspark.llm.queries`.
"""
