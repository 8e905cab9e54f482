"""Training-data operators: ten stand-alone DataFrame operators for text corpora.

Nothing else in the library imports this subpackage; its queries are registered
by ``__spark_entry__.py`` only when the subpackage can be imported.
"""
